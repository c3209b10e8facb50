"""Scans, sinks, projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.columns import json_int
from marlstone.plans.registry import query
from marlstone.sources.tables import as_lines, binary_files, load, over_tables, written

_SHIPPED = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders")


@query(_SHIPPED)
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_orders(spark, sf_dir), "parquet")


@query(_SHIPPED)
def scan_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_orders(spark, sf_dir), "orc")


@query(_SHIPPED)
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_orders(spark, sf_dir), "json")


@query(_SHIPPED)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_orders(spark, sf_dir), "csv")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(load(spark, sf_dir, "customer"), "xml")


@query("SELECT c_name AS value FROM customer")
def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lines(load(spark, sf_dir, "customer"), "c_name")


@query("SELECT CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes, count(*) AS lines FROM customer")
def scan_binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written as text files, and these read as binary: their bytes and line ends."""
    files = binary_files(load(spark, sf_dir, "customer"), "c_name")
    ends = F.length("content") - F.length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")))
    return files.agg(F.sum("length").alias("bytes"), F.sum(ends).cast("long").alias("lines"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scan_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned write, of which the filter reads one folder."""
    kept = _orders(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderstatus")
    read = written(kept, "parquet", "o_orderstatus")
    return read.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT user_id, unnest(range(CAST(user_id % 3 + 1 AS BIGINT))) AS n FROM (SELECT DISTINCT user_id FROM events)")
def inline_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = load(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("user_id") % 3)).alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
       CASE WHEN l_quantity >= 25 THEN 'bulk' ELSE 'small' END AS size_class
FROM lineitem
WHERE l_quantity BETWEEN 10 AND 40 AND l_returnflag IN ('A', 'R') AND l_shipdate < TIMESTAMP '1999-01-01'
""")
def project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "lineitem")
        .filter(F.col("l_quantity").between(10, 40) & F.col("l_returnflag").isin("A", "R"))
        .filter("l_shipdate < timestamp_ntz'1999-01-01'")
        .select(
            "l_orderkey",
            "l_linenumber",
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
            F.when(F.col("l_quantity") >= 25, "bulk").otherwise("small").alias("size_class"),
        )
    )


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' AND regexp_matches(p_type, '^(SMALL|LARGE|PROMO)$')")
def filter_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    return parts.filter(F.col("p_name").like("%ring%") & F.col("p_type").rlike("^(SMALL|LARGE|PROMO)$")).select("p_partkey", "p_name")


@query("""
SELECT o_orderkey, nullif(o_orderstatus, 'O') AS closed_status, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status
FROM orders WHERE nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM NULL OR o_orderpriority IS DISTINCT FROM '5-LOW'
""")
def filter_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = F.nullif(F.col("o_orderstatus"), F.lit("O"))
    return (
        _orders(spark, sf_dir)
        .filter(closed.eqNullSafe(F.lit(None).cast("string")) | ~F.col("o_orderpriority").eqNullSafe("5-LOW"))
        .select("o_orderkey", closed.alias("closed_status"), F.coalesce(closed, F.lit("open")).alias("status"))
    )


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50
""")
def filter_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = load(spark, sf_dir, "events").select("event_id", json_int(F.col("props"), "$.k").alias("k"))
    return read.filter("k >= 50")


@query("SELECT c_custkey, upper(c_mktsegment) AS segment FROM customer WHERE c_acctbal > 0")
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text over a temporary view, with a named parameter."""
    text = "SELECT c_custkey, upper(c_mktsegment) AS segment FROM customer WHERE c_acctbal > :least"
    return over_tables(spark, sf_dir, text, "customer", args={"least": 0})
