"""Further functions, user-defined functions, aggregates, joins and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.sources.slices import TableSlices
from marlstone.sources.tables import load, over_tables
from marlstone.streaming.runs import collected_in_memory, distinct_values, drained, reordered, rocksdb_state, stream_of


@query("""
SELECT c_custkey, CAST(strlen(c_name) AS INTEGER) AS bytes, CAST(len(regexp_extract_all(c_name, '0')) AS INTEGER) AS zeros,
       array_to_string(string_split(c_name, '#'), '|') AS pieces, trim('  ' || c_mktsegment || ' ') AS trimmed,
       concat_ws('-', c_mktsegment, c_name) AS joined, CAST(ascii(c_mktsegment) AS INTEGER) AS code,
       upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2)) AS capital,
       CAST(levenshtein(c_mktsegment, 'MACHINERY') AS INTEGER) AS apart, rpad(c_mktsegment, 12, '.') AS dotted
FROM customer
""")
def functions_strings_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return load(spark, sf_dir, "customer").select(
        "c_custkey",
        F.octet_length(name).alias("bytes"),
        F.regexp_count(name, F.lit("0")).alias("zeros"),
        F.array_join(F.split(name, "#"), "|").alias("pieces"),
        F.trim(F.concat(F.lit("  "), segment, F.lit(" "))).alias("trimmed"),
        F.concat_ws("-", segment, name).alias("joined"),
        F.ascii(segment).alias("code"),
        F.initcap(segment).alias("capital"),
        F.levenshtein(segment, F.lit("MACHINERY")).alias("apart"),
        F.rpad(segment, 12, ".").alias("dotted"),
    )


@query("""
SELECT event_id, CAST(CAST(ts AS DATE) + INTERVAL 2 MONTH AS DATE) AS months_on, CAST(second(ts) AS INTEGER) AS sec,
       ts + INTERVAL 90 MINUTE AS later, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS seconds,
       CAST(quarter(ts) AS INTEGER) AS q, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(hour(ts) AS INTEGER) AS h,
       make_date(CAST(year(ts) AS BIGINT), 1, 1) AS new_year
FROM events
""")
def functions_times_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, day = F.col("ts"), F.to_date("ts")
    since = F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.add_months(day, 2).alias("months_on"),
        F.floor(F.extract(F.lit("SECOND"), ts)).cast("int").alias("sec"),
        (ts + F.expr("INTERVAL '90' MINUTE")).alias("later"),
        since.alias("seconds"),
        F.quarter(ts).alias("q"),
        F.dayofyear(ts).alias("doy"),
        F.hour(ts).alias("h"),
        F.make_date(F.year(ts), F.lit(1), F.lit(1)).alias("new_year"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, ((l_partkey - 1000) % 7 + 7) % 7 AS ring, pow(l_quantity, 2) AS squared,
       log2(l_quantity) AS log_2, cbrt(l_quantity) AS cube_root, atan2(l_discount, l_tax + 1) AS angle,
       TRY_CAST(l_returnflag AS INTEGER) AS flag_number, l_linenumber << 3 AS shifted, lower(to_hex(l_partkey)) AS hexed,
       CAST(CAST(l_quantity AS DECIMAL(10, 2)) * CAST(l_linenumber AS DECIMAL(10, 0)) AS DOUBLE) AS product,
       CAST(l_quantity AS BIGINT) // 10 * 10 AS tens, abs(l_quantity - 25) AS off, CAST(sign(l_quantity - 25) AS INTEGER) AS side,
       l_extendedprice / nullif(l_linenumber - 1, 0) AS guarded
FROM lineitem
""")
def functions_numbers_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_partkey",
        F.pmod(F.col("l_partkey") - 1000, F.lit(7)).alias("ring"),
        F.power(quantity, F.lit(2)).alias("squared"),
        F.log2(quantity).alias("log_2"),
        F.cbrt(quantity).alias("cube_root"),
        F.atan2("l_discount", F.col("l_tax") + 1).alias("angle"),
        F.col("l_returnflag").try_cast("int").alias("flag_number"),
        F.shiftleft("l_linenumber", 3).alias("shifted"),
        F.lower(F.hex("l_partkey")).alias("hexed"),
        (quantity.cast("decimal(10, 2)") * F.col("l_linenumber").cast("decimal(10, 0)")).cast("double").alias("product"),
        F.bround(F.floor(quantity / 10) * 10, 0).cast("long").alias("tens"),
        F.abs(quantity - 25).alias("off"),
        F.sign(quantity - 25).cast("int").alias("side"),
        F.try_divide("l_extendedprice", F.col("l_linenumber") - 1).alias("guarded"),
    )


@query("""
WITH lists AS (
    SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey
)
SELECT o_custkey, CAST(i - 1 AS INTEGER) AS pos, v[i] AS orderkey, list_extract(v, CAST(i + 1 AS BIGINT)) AS after,
       CAST(len(list_distinct(list_concat(v, [v[1], CAST(-1 AS BIGINT)]))) AS INTEGER) AS united,
       CAST(i * 10 + v[i] AS BIGINT) AS zipped
FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM lists)
""")
def functions_arrays_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array_sort(F.collect_list(F.col("o_orderkey").cast("long"))).alias("v")
    lists = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(keys)
    numbers = F.flatten(F.array(F.sequence(F.lit(1), F.size("v"))))
    zipped = F.arrays_zip(numbers.alias("i"), F.col("v").alias("x"))
    return (
        lists.withColumn("pairs", F.transform(zipped, lambda p: p["i"] * 10 + p["x"]))
        .select("o_custkey", "v", "pairs", F.posexplode("v").alias("pos", "orderkey"))
        .select(
            "o_custkey",
            "pos",
            "orderkey",
            F.try_element_at("v", F.col("pos") + 2).alias("after"),
            F.size(F.array_union("v", F.array(F.element_at("v", 1), F.lit(-1).cast("long")))).alias("united"),
            F.get("pairs", F.col("pos")).alias("zipped"),
        )
    )


@query("""
SELECT c_custkey, c_mktsegment || '/' || c_nationkey AS pair, 'nation,segment' AS names, CAST(c_nationkey AS VARCHAR) AS nation,
       c_acctbal AS balance FROM customer
""")
def functions_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey").cast("string")
    mapped = F.create_map(F.lit("nation"), nation, F.lit("segment"), F.col("c_mktsegment"))
    made = load(spark, sf_dir, "customer").select(
        "c_custkey", mapped.alias("m"), F.named_struct(F.lit("at"), F.struct(nation.alias("nation")), F.lit("balance"), "c_acctbal").alias("s")
    )
    return made.select(
        "c_custkey",
        F.array_join(F.reverse(F.map_values("m")), "/").alias("pair"),
        F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"),
        "s.at.nation",
        "s.balance",
    )


@query("""
WITH m AS (
    SELECT c_mktsegment, c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS d FROM customer
)
SELECT c_mktsegment, round(avg(d * d * d) / pow(avg(d * d), 1.5), 6) AS skew, round(avg(d * d * d * d) / pow(avg(d * d), 2) - 3, 6) AS kurt
FROM m GROUP BY c_mktsegment
""")
def aggregate_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewness and excess kurtosis of the population; the SQL has them by their formulas."""
    grouped = load(spark, sf_dir, "customer").groupBy("c_mktsegment")
    return grouped.agg(F.round(F.skewness("c_acctbal"), 6).alias("skew"), F.round(F.kurtosis("c_acctbal"), 6).alias("kurt"))


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
def aggregate_grouping_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("SELECT event_type AS item, count(*) AS n FROM events GROUP BY event_type")
def aggregate_top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent types by an approximate sketch, exact while it holds all of them."""
    text = "SELECT item.item, item.count AS n FROM (SELECT explode(approx_top_k(event_type, 20, 1000)) AS item FROM events)"
    return over_tables(spark, sf_dir, text, "events")


@query("SELECT p_partkey, lower(p_brand) || '-' || p_size AS label, p_size * 2 AS twice FROM part")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain Python function, by pickled rows and by Arrow batches."""
    label = F.udf(lambda brand, size: f"{brand.lower()}-{size}", "string")
    twice = F.udf(lambda size: size * 2, "int", useArrow=True)
    return load(spark, sf_dir, "part").select("p_partkey", label("p_brand", "p_size").alias("label"), twice("p_size").alias("twice"))


@query("SELECT o_orderkey, o_totalprice - o_totalprice * 0.1 AS net FROM orders WHERE o_orderstatus <> 'P'")
def udf_partition_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def net(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = frame[frame["o_orderstatus"] != "P"]
            yield pd.DataFrame({"o_orderkey": kept["o_orderkey"], "net": kept["o_totalprice"] - kept["o_totalprice"] * 0.1})

    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").mapInPandas(net, "o_orderkey long, net double")


@query("SELECT l.l_orderkey, l.l_linenumber, n.n_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey")
def join_replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations, a table of fixed size, are replicated to the suppliers by a nested loop; the lines then meet few rows."""
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_name").hint("shuffle_replicate_nl")
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    few = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return lines.join(few, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "n_name")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data source written in Python, which reads slices of a table in tasks of their own."""
    spark.dataSource.register(TableSlices)
    return spark.read.format("table_slices").schema("c_custkey long, c_name string, c_acctbal double").load(f"{sf_dir}/customer.parquet")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stream_of(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return collected_in_memory(counts, "complete")


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def stream_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of our own by a stateful processor: the kinds of events that a user has had."""
    kinds = distinct_values(stream_of(spark, sf_dir, "events").select("user_id", "event_type"), "user_id", "event_type")
    with rocksdb_state(spark):
        return drained(kinds, "processor", "update", ["user_id"])


@query("""
WITH placed AS (
    SELECT *, CAST(floor(event_id * 4 / (SELECT max(event_id) + 1 FROM events)) AS INTEGER) AS quarter FROM events
), first_half AS (
    SELECT max(ts) AS seen FROM placed WHERE quarter IN (2, 3)
)
SELECT date_trunc('day', ts) AS day, count(*) AS n FROM placed, first_half
WHERE quarter >= 2 OR date_trunc('day', ts) + INTERVAL 1 DAY > seen - INTERVAL 1 HOUR GROUP BY ALL
""")
def stream_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the events comes first, so days of the earlier half are closed when theirs come."""
    late = reordered(spark, sf_dir, "events", "ts", "event_id")
    counts = late.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return drained(counts.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n"), "late", "update", ["day"])
