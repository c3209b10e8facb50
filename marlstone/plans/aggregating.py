"""Aggregation, grouping sets and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.aggregates import exact_avg, exact_sum, two_stage
from marlstone.operators.quantiles import exact_quantiles
from marlstone.plans.registry import query
from marlstone.sources.tables import load, over_tables

_DEC = "CAST(sum(CAST({} AS DECIMAL(20, {}))) AS DOUBLE)"


@query(f"""
SELECT l_returnflag, l_linestatus, {_DEC.format('l_quantity', 2)} AS sum_qty, {_DEC.format('l_extendedprice', 2)} AS sum_base,
       {_DEC.format('l_extendedprice * (1 - l_discount)', 4)} AS sum_disc,
       {_DEC.format('l_extendedprice * (1 - l_discount) * (1 + l_tax)', 6)} AS sum_charge,
       {_DEC.format('l_quantity', 2)} / count(l_quantity) AS avg_qty, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one pass over a few columns, combined before a tiny shuffle."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        load(spark, sf_dir, "lineitem")
        .filter("l_shipdate <= timestamp_ntz'2001-06-01'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            exact_sum("l_quantity").alias("sum_qty"),
            exact_sum("l_extendedprice").alias("sum_base"),
            exact_sum(net, 4).alias("sum_disc"),
            exact_sum(net * (1 + F.col("l_tax")), 6).alias("sum_charge"),
            exact_avg("l_quantity").alias("avg_qty"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


@query("""
SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most, min(o_totalprice) AS least FROM orders
GROUP BY o_custkey HAVING count(*) >= 10
""")
def aggregate_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return (
        orders.groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"), F.min("o_totalprice").alias("least"))
        .filter("n >= 10")
    )


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
def aggregate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts of few, hot groups: deduplicated by key first, then counted."""
    pairs = load(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("m"))
    return pairs.groupBy("event_type").agg(F.count(F.lit(1)).alias("users"), F.sum("m").alias("n"))


@query("SELECT event_type, count(DISTINCT value) AS kinds, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def aggregate_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts of few, hot types: equal values share a salt, so the counts of salts add up."""

    def distinct(column: str, name: str) -> DataFrame:
        pairs = load(spark, sf_dir, "events").select("event_type", column)
        return two_stage(pairs, ["event_type"], {name: F.count_distinct(column)}, {name: F.sum(name)})

    return distinct("value", "kinds").join(distinct("user_id", "users"), "event_type")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY o_orderpriority")
def aggregate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(done.alias("done"), F.count(F.lit(1)).alias("n"))


_SETS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS g FROM orders GROUP BY {}"


@query(_SETS.format("ROLLUP (o_orderstatus, o_orderpriority)"))
def aggregate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = load(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority")
    return rolled.agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("int").alias("g"))


@query(_SETS.format("CUBE (o_orderstatus, o_orderpriority)"))
def aggregate_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cubed = load(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return cubed.agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("int").alias("g"))


@query(_SETS.format("GROUPING SETS ((o_orderstatus), (o_orderpriority))"))
def aggregate_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    sets = orders.groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("int").alias("g"))


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS s, count(*) AS n FROM orders WHERE o_totalprice < 0")
def aggregate_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").filter("o_totalprice < 0").agg(F.sum("o_custkey").alias("s"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS median, quantile_disc(c_acctbal, 0.25) AS quarter
FROM customer GROUP BY c_mktsegment
""")
def aggregate_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a running sum over distinct values, as Spark's own exact percentile gathers a group's values in one task."""
    customers = load(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    return exact_quantiles(customers, ["c_mktsegment"], "c_acctbal", {"median": (0.5, True), "quarter": (0.25, False)})


@query("""
SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.99) AS most, quantile_disc(l_quantity * 100 + l_linenumber, 0.5) AS middle
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def aggregate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of few groups, each with a large share of the rows."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_extendedprice", (F.col("l_quantity") * 100 + F.col("l_linenumber")).alias("mixed")
    )
    keys = ["l_returnflag", "l_linestatus"]
    most = exact_quantiles(lines, keys, "l_extendedprice", {"most": (0.99, True)})
    return most.join(exact_quantiles(lines, keys, "mixed", {"middle": (0.5, False)}), keys)


_STATS = """
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS correlation,
       round(stddev_samp(l_quantity), 6) AS deviation, round(var_pop(l_discount), 9) AS variance,
       round(covar_samp(l_quantity, l_tax), 6) AS covariance, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem GROUP BY l_returnflag
"""


@query(_STATS)
def aggregate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_tables(spark, sf_dir, _STATS, "lineitem")


@query("""
SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest
FROM orders GROUP BY o_custkey
""")
def aggregate_arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("o_totalprice", "o_orderkey")
    grouped = load(spark, sf_dir, "orders").groupBy("o_custkey")
    return grouped.agg(F.max_by("o_orderkey", order).alias("dearest"), F.min_by("o_orderkey", order).alias("cheapest"))


@query("""
SELECT c_mktsegment, bool_and(c_acctbal > -999) AS every_one, bool_or(c_acctbal > 9990) AS any_one,
       bit_xor(c_custkey) AS mixed, bit_or(c_nationkey) AS bits FROM customer GROUP BY c_mktsegment
""")
def aggregate_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.bool_and(F.col("c_acctbal") > -999).alias("every_one"),
        F.bool_or(F.col("c_acctbal") > 9990).alias("any_one"),
        F.bit_xor("c_custkey").alias("mixed"),
        F.bit_or("c_nationkey").alias("bits"),
    )


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, CAST(list(n_nationkey ORDER BY n_nationkey) AS VARCHAR) AS keys FROM nation GROUP BY n_regionkey")
def aggregate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_join(F.array_sort(F.collect_list("n_name")), ",")
    keys = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("n_nationkey")), ", "), F.lit("]"))
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("names"), keys.alias("keys"))


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority
""")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = load(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return counted.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"])


@query("""
SELECT p_partkey, 'size' AS measure, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part
""")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return parts.unpivot("p_partkey", ["size", "price"], "measure", "value")


@query("""
SELECT o_orderstatus, count(DISTINCT o_custkey) AS exact, quantile_cont(o_totalprice, 0.5) AS median, true AS close, true AS held
FROM orders GROUP BY o_orderstatus
""")
def aggregate_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts and quantiles, judged against the exact ones."""
    grouped = load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("o_custkey")).alias("about"),
        F.count_distinct("o_custkey").alias("exact"),
        F.percentile_approx("o_totalprice", 0.5, 1000).alias("middle"),
        F.percentile("o_totalprice", 0.5).alias("median"),
    )
    return grouped.select(
        "o_orderstatus",
        "exact",
        "median",
        (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact") + 2).alias("close"),
        (F.abs(F.col("middle") - F.col("median")) <= 0.05 * F.col("median")).alias("held"),
    )
