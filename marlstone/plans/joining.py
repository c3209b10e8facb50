"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.joins import asof_join, greater_join, not_in, overlap_join, range_join, skew_join, top_per_group
from marlstone.plans.registry import query
from marlstone.sources.tables import load, over_tables


@query("SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = load(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_name", "c_mktsegment")
    return load(spark, sf_dir, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


def _half_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_totalprice")


def _late_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


_OUTER = """
SELECT o.o_orderkey, o.o_totalprice, l.l_orderkey, l.l_linenumber, l.l_quantity
FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000) o
{} JOIN (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45) l ON o.o_orderkey = l.l_orderkey
"""


def _outer(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    on = F.col("o_orderkey") == F.col("l_orderkey")
    return _half_orders(spark, sf_dir).join(_late_lines(spark, sf_dir), on, how)


@query(_OUTER.format("LEFT"))
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "left")


@query(_OUTER.format("RIGHT"))
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "right")


@query(_OUTER.format("FULL"))
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "full")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND o_totalprice > 200000")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_null_aware_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_in(load(spark, sf_dir, "orders"), "o_orderkey", load(spark, sf_dir, "lineitem"), "l_orderkey").select("o_orderkey")


@query("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 regions with the 25 nations, tables of fixed size."""
    return load(spark, sf_dir, "region").select("r_name").crossJoin(load(spark, sf_dir, "nation").select("n_name"))


@query("""
SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c
ON s.s_nationkey = c.c_nationkey AND c.c_acctbal > s.s_acctbal + 9000
""")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", (F.col("s_acctbal") + 9000).alias("above"))
    return greater_join(customers, suppliers, ["nation"], "c_acctbal", "above").select("s_suppkey", "c_custkey")


@query("""
SELECT l.l_orderkey, l.l_linenumber, o.o_orderkey
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
 AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate < o.o_orderdate + INTERVAL 30 DAY
""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = F.expr("l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL '30' DAY")
    return load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), on).select("l_orderkey", "l_linenumber", "o_orderkey")


@query("""
SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s
ON p.p_retailprice >= s.s_acctbal AND p.p_retailprice < s.s_acctbal + 10
""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 10).alias("high"))
    points = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return range_join(points, ranges, "p_retailprice", "low", "high", 10).select("p_partkey", "s_suppkey")


_BANDS = """
SELECT p.p_partkey, s.s_suppkey, least(p.p_high, s.s_high) - greatest(p.p_low, s.s_low) AS shared
FROM (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS p_low,
             CAST(round(p_retailprice * 100) AS BIGINT) + p_size * p_size AS p_high FROM part) p
JOIN (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS s_low,
             CAST(round(s_acctbal * 100) AS BIGINT) + (1 << (s_nationkey % 18)) AS s_high FROM supplier) s
ON p.p_low < s.s_high AND s.s_low < p.p_high
"""


@query(_BANDS)
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price bands of parts and balance bands of suppliers, 1 to 131,072 cents long, that overlap."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    parts = load(spark, sf_dir, "part").select("p_partkey", cents("p_retailprice").alias("p_low"), (cents("p_retailprice") + F.col("p_size") * F.col("p_size")).alias("p_high"))
    width = F.expr("shiftleft(1, s_nationkey % 18)")
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", cents("s_acctbal").alias("s_low"), (cents("s_acctbal") + width).alias("s_high"))
    shared = F.least("p_high", "s_high") - F.greatest("p_low", "s_low")
    return overlap_join(parts, suppliers, ("p_low", "p_high"), ("s_low", "s_high")).select("p_partkey", "s_suppkey", shared.alias("shared"))


@query("""
SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view') v
ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(bought, views, "ts", "ts", ["user_id"], ["view_id", "view_value"]).drop("ts")


@query("""
SELECT p.event_id, v.event_id AS next_view
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') v
ON p.user_id = v.user_id AND p.ts < v.ts
""")
def join_asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("next_view"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(bought, views, "ts", "ts", ["user_id"], ["next_view"], "forward", strict=True).select("event_id", "next_view")


@query("""
SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c,
LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t
""")
def join_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2)
    return load(spark, sf_dir, "customer").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT p_partkey, p_retailprice FROM part p
WHERE p_retailprice > (SELECT avg(p_size) * 38 FROM part q WHERE q.p_brand = p.p_brand)
""")
def join_correlated_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        "SELECT p_partkey, p_retailprice FROM part p"
        " WHERE p_retailprice > (SELECT avg(p_size) * 38 FROM part q WHERE q.p_brand = p.p_brand)"
    )
    return over_tables(spark, sf_dir, text, "part")


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber")
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority")
    return skew_join(lines, orders, ["key"]).select(F.col("key").alias("l_orderkey"), "l_linenumber", "o_orderpriority")


@query("""
SELECT n.n_name, CAST(sum(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(20, 4))) AS DOUBLE) AS revenue
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE o.o_orderdate >= TIMESTAMP '1996-01-01' AND o.o_orderdate < TIMESTAMP '1999-01-01'
GROUP BY n.n_name
""")
def join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.operators.aggregates import exact_sum

    t = {n: load(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    orders = t["orders"].filter("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1999-01-01'")
    return (
        t["lineitem"]
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("n_name")
        .agg(exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))
    )
