"""Scalar functions on strings, times, numbers, arrays, maps and JSON, and user-defined functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.columns import day_of_week, half_up, ratio, truncated
from marlstone.plans.registry import query
from marlstone.sources.tables import load, over_tables


@query("""
SELECT c_custkey, upper(c_mktsegment) AS up, c_name || '/' || c_mktsegment AS joined, substring(c_name, 3, 5) AS part,
       CAST(length(c_name) AS INTEGER) AS len, replace(c_name, '0', 'o') AS replaced, regexp_replace(c_name, '[0-9]+', '#', 'g') AS masked,
       regexp_extract(c_name, '([0-9]+)', 1) AS digits, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded,
       reverse(c_mktsegment) AS turned, md5(c_name) AS digest, sha256(c_name) AS sha, CAST(instr(c_name, '#') AS INTEGER) AS at,
       starts_with(c_mktsegment, 'B') AS b, translate(c_mktsegment, 'AEIOU', 'aeiou') AS vowels, split_part(c_name, '#', 2) AS tail
FROM customer
""")
def functions_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return load(spark, sf_dir, "customer").select(
        "c_custkey",
        F.upper(segment).alias("up"),
        F.concat(name, F.lit("/"), segment).alias("joined"),
        F.substring(name, 3, 5).alias("part"),
        F.length(name).alias("len"),
        F.replace(name, F.lit("0"), F.lit("o")).alias("replaced"),
        F.regexp_replace(name, "[0-9]+", "#").alias("masked"),
        F.regexp_extract(name, "([0-9]+)", 1).alias("digits"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
        F.reverse(segment).alias("turned"),
        F.md5(name).alias("digest"),
        F.sha2(name, 256).alias("sha"),
        F.instr(name, "#").alias("at"),
        F.startswith(segment, F.lit("B")).alias("b"),
        F.translate(segment, "AEIOU", "aeiou").alias("vowels"),
        F.split_part(name, F.lit("#"), F.lit(2)).alias("tail"),
    )


@query("""
SELECT event_id, date_trunc('hour', ts) AS hour, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m,
       CAST(weekofyear(ts) AS INTEGER) AS week, CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(ts AS DATE) AS day,
       CAST(CAST(ts AS DATE) + 10 AS DATE) AS later, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS days,
       strftime(ts, '%Y-%m') AS label, last_day(ts) AS month_end, epoch_us(ts) AS micros
FROM events
""")
def functions_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, day = F.col("ts"), F.to_date("ts")
    return load(spark, sf_dir, "events").select(
        "event_id",
        truncated("hour", ts).alias("hour"),
        F.year(ts).alias("y"),
        F.month(ts).alias("m"),
        F.weekofyear(ts).alias("week"),
        day_of_week(ts).alias("dow"),
        day.alias("day"),
        F.date_add(day, 10).alias("later"),
        F.datediff(day, F.lit("2024-01-01").cast("date")).alias("days"),
        F.date_format(ts, "yyyy-MM").alias("label"),
        F.last_day(day).alias("month_end"),
        F.unix_micros(ts.cast("timestamp")).alias("micros"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) AS down, CAST(ceil(l_extendedprice) AS BIGINT) AS up,
       l_partkey % 7 AS rest, l_partkey // 7 AS whole, sqrt(l_quantity) AS root, ln(l_quantity) AS log_e, log10(l_quantity) AS log_10,
       greatest(l_discount, l_tax) AS most, floor(l_tax * 10.0 + 0.5) / 10.0 AS tenth, l_discount / nullif(l_tax, 0) AS share,
       CAST(l_extendedprice AS DECIMAL(12, 1)) AS dec, CAST(bit_count(l_partkey) AS INTEGER) AS ones
FROM lineitem
""")
def functions_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.floor("l_extendedprice").alias("down"),
        F.ceil("l_extendedprice").alias("up"),
        (F.col("l_partkey") % 7).alias("rest"),
        F.expr("l_partkey DIV 7").alias("whole"),
        F.sqrt("l_quantity").alias("root"),
        F.ln("l_quantity").alias("log_e"),
        F.log10("l_quantity").alias("log_10"),
        F.greatest("l_discount", "l_tax").alias("most"),
        half_up(F.col("l_tax"), 1).alias("tenth"),
        ratio(F.col("l_discount"), F.col("l_tax")).alias("share"),
        F.col("l_extendedprice").cast("decimal(12, 1)").alias("dec"),
        F.bit_count("l_partkey").alias("ones"),
    )


@query("""
SELECT user_id, CAST(len(v) AS INTEGER) AS n, v[1] AS first, list_max(v) AS most, list_sum(list_filter(v, lambda x: x % 2 = 0)) AS even,
       array_to_string(list_transform(v[1:3], lambda x: x * 2), ',') AS doubled, list_contains(v, 7) AS has_seven,
       CAST(len(list_distinct(v)) AS INTEGER) AS kinds
FROM (SELECT user_id, list(CAST(json_extract_string(props, '$.k') AS BIGINT) ORDER BY event_id) AS v FROM events GROUP BY user_id)
""".replace("list_sum(list_filter(v, lambda x: x % 2 = 0))", "CAST(coalesce(list_sum(list_filter(v, lambda x: x % 2 = 0)), 0) AS BIGINT)"))
def functions_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    lists = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", k.alias("k")))).alias("s"))
    v = F.col("v")
    return lists.select("user_id", F.transform("s", lambda x: x["k"]).alias("v")).select(
        "user_id",
        F.size(v).alias("n"),
        F.element_at(v, 1).alias("first"),
        F.array_max(v).alias("most"),
        F.aggregate(F.filter(v, lambda x: x % 2 == 0), F.lit(0).cast("long"), lambda a, x: a + x).alias("even"),
        F.array_join(F.transform(F.slice(v, 1, 3), lambda x: x * 2), ",").alias("doubled"),
        F.array_contains(v, 7).alias("has_seven"),
        F.size(F.array_distinct(v)).alias("kinds"),
    )


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(o_orderpriority)) AS BIGINT) AS chars FROM orders GROUP BY o_orderpriority")
def functions_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("o_orderpriority")).alias("chars")
    )
    mapped = counted.select("o_orderpriority", F.create_map(F.lit("n"), F.col("n"), F.lit("chars"), F.col("chars")).alias("m"))
    return mapped.select("o_orderpriority", F.col("m")["n"].alias("n"), F.element_at("m", "chars").alias("chars"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS next FROM events")
def functions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return load(spark, sf_dir, "events").select("event_id", (parsed["k"] + 1).alias("next"))


@query("SELECT p_partkey, p_retailprice * 2 + p_size AS score FROM part")
def udf_vectorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def score(price: pd.Series, size: pd.Series) -> pd.Series:
        return price * 2 + size

    return load(spark, sf_dir, "part").select("p_partkey", score("p_retailprice", "p_size").alias("score"))


@query("SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY c_mktsegment")
def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(balance: pd.Series) -> float:
        return balance.max() - balance.min()

    # the function sees two balances of a segment, however many customers it has
    ends = load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    balances = ends.select("c_mktsegment", F.explode(F.array("low", "high")).alias("c_acctbal"))
    return balances.groupBy("c_mktsegment").agg(spread("c_acctbal").alias("spread"))


@query("SELECT n_nationkey, unnest(string_split(n_name, '_')) AS word FROM nation")
def udf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str) -> Iterator[tuple[str]]:
            for word in text.split("_"):
                yield (word,)

    spark.udtf.register("split_words", Words)
    return over_tables(spark, sf_dir, "SELECT n_nationkey, w.word FROM nation, LATERAL split_words(n_name) w", "nation")


@query("""
SELECT user_id, event_id, value - first_value(value) OVER (PARTITION BY user_id ORDER BY ts) AS change FROM events
""")
def udf_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of a user is joined to its events, which are then dealt in slices of about 50,000."""

    def change(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(change=rows["value"] - rows["first"])[["user_id", "event_id", "change"]]

    events = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    order = F.struct(F.col("ts").isNull(), "ts", "event_id")
    firsts = events.groupBy(F.col("user_id").alias("user")).agg(
        F.min_by("value", order).alias("first"), F.ceil(F.count(F.lit(1)) / 50_000).alias("slices")
    )
    sliced = events.join(firsts, F.col("user_id").eqNullSafe(F.col("user"))).withColumn(
        "slice", F.pmod(F.xxhash64("event_id"), F.col("slices"))
    )
    # else the join's partitioning by user would serve, with all slices of a user in one task
    dealt = sliced.repartition("user_id", "slice")
    return dealt.groupBy("user_id", "slice").applyInPandas(change, "user_id long, event_id long, change double")


@query("""
SELECT c.c_nationkey AS nationkey, count(DISTINCT c.c_custkey) AS customers, count(DISTINCT s.s_suppkey) AS suppliers
FROM customer c FULL JOIN supplier s ON c.c_nationkey = s.s_nationkey WHERE c.c_nationkey IS NOT NULL GROUP BY c.c_nationkey
""")
def udf_cogrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counts(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"nationkey": left["c_nationkey"], "customers": left["n"], "suppliers": right["n"].sum()})

    # counted before, so that the function sees one row of a nation from each side
    customers = load(spark, sf_dir, "customer").filter("c_nationkey IS NOT NULL").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("n"))
    suppliers = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("n"))
    return customers.groupBy("c_nationkey").cogroup(suppliers.groupBy("s_nationkey")).applyInPandas(counts, "nationkey int, customers long, suppliers long")


@query("SELECT o_orderkey, o_totalprice / 100 AS hundreds FROM orders WHERE o_totalprice > 100000")
def udf_partition_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    def hundreds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pc.greater(batch.column(1), 100000))
            yield pa.record_batch([kept.column(0), pc.divide(kept.column(1), 100.0)], names=["o_orderkey", "hundreds"])

    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInArrow(hundreds, "o_orderkey long, hundreds double")
