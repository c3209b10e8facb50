"""Window functions, sorting, limits and top-k, set operations and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.operators.joins import top_per_group
from marlstone.operators.running import Running, running
from marlstone.plans.registry import query
from marlstone.sources.shared import setting, staged
from marlstone.sources.tables import load, over_tables

_BY_PRICE = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"


@query(f"""
SELECT o_orderkey, CAST(row_number() {_BY_PRICE} AS INTEGER) AS nth, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS r,
       CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS d,
       percent_rank() {_BY_PRICE} AS pr, cume_dist() {_BY_PRICE} AS cd, CAST(ntile(4) {_BY_PRICE} AS INTEGER) AS quarter
FROM orders
""")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_price = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    by_status = W.partitionBy("o_custkey").orderBy("o_orderstatus")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.row_number().over(by_price).alias("nth"),
        F.rank().over(by_status).alias("r"),
        F.dense_rank().over(by_status).alias("d"),
        F.percent_rank().over(by_price).alias("pr"),
        F.cume_dist().over(by_price).alias("cd"),
        F.ntile(4).over(by_price).alias("quarter"),
    )


@query("""
SELECT event_id, lag(value) OVER u AS before, lead(value, 2, -1.0) OVER u AS later, first_value(event_id) OVER u AS first_id,
       nth_value(event_id, 2) OVER u AS second_id
FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)
""")
def window_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_time = W.partitionBy("user_id").orderBy("ts")
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.lag("value").over(by_time).alias("before"),
        F.lead("value", 2, -1.0).over(by_time).alias("later"),
        F.first("event_id").over(by_time).alias("first_id"),
        F.nth_value("event_id", 2).over(by_time).alias("second_id"),
    )


@query("""
SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near_most,
       count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour
FROM events
""")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """
        SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near_most,
               count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS in_hour
        FROM events"""
    return over_tables(spark, sf_dir, text, "events")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
       OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_bought
FROM events
""")
def window_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", bought.alias("bought"))
    carried = running(events, ["user_id"], [("ts", True)], {"last_bought": Running("last", "bought")})
    return carried.select("event_id", "last_bought")


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag,
       sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far,
       coalesce(max(l_extendedprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS most_before
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice)
""")
def window_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum and maximum over three keys, each with a third of all rows, which are cut into pieces of time."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice")
    order = [(c, True) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")]
    values = {"so_far": Running("sum", "l_quantity"), "most": Running("max", "l_extendedprice", strict=True)}
    done = running(lines, ["l_returnflag"], order, values)
    return done.select("l_orderkey", "l_linenumber", "l_returnflag", "so_far", F.coalesce("most", F.lit(-1.0)).alias("most_before"))


@query("""
WITH marked AS (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events
), numbered AS (
    SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM marked
)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM numbered GROUP BY user_id, session
""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, by_time = load(spark, sf_dir, "events").select("user_id", "ts", "event_id"), [("ts", True), ("event_id", True)]
    before = running(events, ["user_id"], by_time, {"before": Running("last", "ts", strict=True)})
    goes_on = F.col("ts") - F.col("before") <= F.expr("INTERVAL '6' HOUR")
    marked = staged(before.withColumn("starts", F.when(goes_on, 0).otherwise(1)), "session-starts")
    numbered = running(marked, ["user_id"], by_time, {"session": Running("sum", "starts")})
    return numbered.groupBy("user_id", "session").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended")
    )


@query("SELECT c_nationkey, c_custkey, c_acctbal, CAST(row_number() OVER w AS INTEGER) AS nth FROM customer QUALIFY row_number() OVER w <= 3 WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)".replace("QUALIFY row_number() OVER w <= 3 WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)", "WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) QUALIFY row_number() OVER w <= 3"))
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return top_per_group(customers, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 200")
def limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").offset(200).limit(50).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders ORDER BY status ASC NULLS LAST, o_orderkey LIMIT 100")
def sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status"))
    return rows.orderBy(F.col("status").asc_nulls_last(), "o_orderkey").limit(100)


@query("SELECT c_custkey, c_acctbal FROM customer")
def sort_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total order by ranges, each sorted in its own task."""
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rows.repartitionByRange("c_acctbal", "c_custkey").sortWithinPartitions("c_acctbal", "c_custkey")


_A, _B = "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 150000", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rich = load(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return load(spark, sf_dir, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("k")), rich


@query(f"{_A} UNION {_B}")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.union(b).distinct()


@query(f"{_A} UNION ALL {_B}")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.unionByName(b)


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.intersect(b)


@query(f"{_A} INTERSECT ALL {_B}")
def set_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.intersectAll(b)


@query(f"{_A} EXCEPT {_B}")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.subtract(b)


@query(f"{_A} EXCEPT ALL {_B}")
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.exceptAll(b)


_STEPS = """
WITH RECURSIVE steps(c_custkey, depth) AS (
    SELECT c_custkey, 0 FROM customer
    UNION ALL SELECT c_custkey {}, depth + 1 FROM steps WHERE c_custkey % 2 = 0 AND c_custkey <> 0
) SELECT c_custkey, depth FROM steps
"""


@query(_STEPS.format("// 2"))
def recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halve all keys until they are odd or 0; every step is a row."""
    # Spark ends recursions of more than a million rows unless told otherwise when they run
    with setting(spark, "spark.sql.cteRecursionRowLimit", "-1"):
        return staged(over_tables(spark, sf_dir, _STEPS.format("DIV 2"), "customer"), "recursion")
