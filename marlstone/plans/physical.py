"""Queries that steer the physical plan, and further aggregates, windows and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.sources.shared import new_path
from marlstone.sources.tables import load, views
from marlstone.streaming.runs import drained, stream_of

_PAIRS = """
SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return lines, load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")


@query(_PAIRS)
def join_sort_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _sides(spark, sf_dir)
    return lines.join(orders.hint("merge"), "l_orderkey")


@query(_PAIRS)
def join_shuffled_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _sides(spark, sf_dir)
    return lines.join(orders.hint("shuffle_hash"), "l_orderkey")


@query(_PAIRS)
def join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides written in buckets of the key, so that the join needs no shuffle."""
    names = []
    for side, rows in zip(("lines", "orders"), _sides(spark, sf_dir), strict=True):
        path = new_path(spark, f"bucketed-{side}")
        names.append(f"bucketed_{path.rsplit('-', 1)[1]}")
        rows.write.bucketBy(8, "l_orderkey").sortBy("l_orderkey").option("path", path).saveAsTable(names[-1])
    lines, orders = map(spark.table, names)
    return lines.join(orders.hint("merge"), "l_orderkey")


@query("SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nations, a table of fixed size, travel to the customers."""
    nations = F.broadcast(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    joined = load(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
       count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus
""")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "orders").crosstab("o_orderstatus", "o_orderpriority")
    return table.select(F.col("o_orderstatus_o_orderpriority").alias("status"), F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


@query("SELECT c_nationkey, string_agg(c_mktsegment, ';' ORDER BY c_mktsegment) AS segments FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY c_nationkey")
def aggregate_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT c_nationkey, listagg(c_mktsegment, ';') WITHIN GROUP (ORDER BY c_mktsegment) AS segments FROM segments GROUP BY c_nationkey"
    with views(spark, segments=load(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()):
        return spark.sql(text)


@query("SELECT c_custkey, max(c_acctbal) OVER (PARTITION BY c_nationkey) - c_acctbal AS below FROM customer")
def udf_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def most(balance: pd.Series) -> float:
        return balance.max()

    # the window holds one maximum of each segment of a nation; the nations, a table of fixed size, travel to the customers
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    partials = customers.groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_acctbal").alias("balance"))
    best = partials.select(F.col("c_nationkey").alias("nation"), most("balance").over(W.partitionBy("c_nationkey")).alias("most")).distinct()
    joined = customers.join(F.broadcast(best), F.col("c_nationkey").eqNullSafe(F.col("nation")))
    return joined.select("c_custkey", (F.col("most") - F.col("c_acctbal")).alias("below"))


@query("""
SELECT user_id, count(*) AS n FROM (
    SELECT DISTINCT user_id, event_type, event_id FROM (SELECT * FROM events UNION ALL SELECT * FROM events)
) GROUP BY user_id
""")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come twice, kept once within the watermark."""
    twice = stream_of(spark, sf_dir, "events", "ts").union(stream_of(spark, sf_dir, "events", "ts"))
    once = twice.dropDuplicatesWithinWatermark(["event_id"]).select("user_id", "event_id")
    return drained(once, "dedup").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, CAST(0 AS BIGINT) AS others, true AS a_tenth FROM orders
""")
def sample_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratified sample: all urgent orders, a tenth of the low ones."""
    orders = load(spark, sf_dir, "orders").select("o_orderpriority")
    sampled = orders.sampleBy("o_orderpriority", {"1-URGENT": 1.0, "5-LOW": 0.1}, seed=1)
    low = F.count_if(F.col("o_orderpriority") == "5-LOW")
    all_low = orders.agg(low.alias("all_low"))
    counts = sampled.agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        low.alias("low"),
        F.count_if(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).alias("others"),
    )
    # one row each; five standard deviations about a tenth
    spread = 5 * F.sqrt(F.col("all_low") * 0.09)
    return counts.crossJoin(all_low).select(
        "urgent", "others", (F.abs(F.col("low") - 0.1 * F.col("all_low")) <= spread).alias("a_tenth")
    )


@query("SELECT DISTINCT event_type AS item FROM events")
def frequent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that make up a tenth of all rows, found in one pass."""
    found = load(spark, sf_dir, "events").freqItems(["event_type"], 0.1)
    return found.select(F.explode("event_type_freqItems").alias("item"))
