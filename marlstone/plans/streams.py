"""Streaming queries over the tables, compared with the same result in batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.sources.tables import load
from marlstone.streaming.runs import drained, running_totals, stream_of


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream_of(spark, sf_dir, "events", "ts")
    windows = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    flat = windows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "most")
    return drained(flat, "tumbling", "complete")


@query("""
SELECT start, count(*) AS n FROM (
    SELECT unnest([date_trunc('day', ts) + INTERVAL 12 HOUR * (CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END),
                   date_trunc('day', ts) + INTERVAL 12 HOUR * (CASE WHEN hour(ts) >= 12 THEN 0 ELSE -1 END)]) AS start FROM events
) GROUP BY start
""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream_of(spark, sf_dir, "events", "ts")
    windows = events.groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return drained(windows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "sliding", "update", ["start"])


@query("""
WITH marked AS (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events
), numbered AS (
    SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM marked
)
SELECT user_id, min(ts) AS began, count(*) AS n FROM numbered GROUP BY user_id, s
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream_of(spark, sf_dir, "events", "ts")
    found = events.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return drained(found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "n"), "sessions", "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream_of(spark, sf_dir, "events").select("user_id", "event_type")
    return drained(events.dropDuplicates(["user_id", "event_type"]), "distinct")


@query("SELECT e.event_id, c.c_mktsegment FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'error'")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream_of(spark, sf_dir, "events").filter("event_type = 'error'")
    joined = events.join(load(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    return drained(joined.select("event_id", "c_mktsegment"), "static-join")


@query("""
SELECT v.event_id AS view_id, p.event_id AS bought_id FROM events v JOIN events p
ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 2 HOUR
WHERE v.event_type = 'view' AND p.event_type = 'purchase'
""")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = stream_of(spark, sf_dir, "events", "ts").filter("event_type = 'view'")
    bought = stream_of(spark, sf_dir, "events", "ts").filter("event_type = 'purchase'")
    views = views.select(F.col("event_id").alias("view_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("seen"))
    bought = bought.select(F.col("event_id").alias("bought_id"), "user_id", "ts")
    on = F.expr("viewer = user_id AND ts >= seen AND ts <= seen + INTERVAL '2' HOUR")
    return drained(views.join(bought, on).select("view_id", "bought_id"), "stream-join")


@query("SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY user_id")
def stream_own_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(running_totals(stream_of(spark, sf_dir, "events").select("user_id", "value"), "user_id", "value"), "state", "update", ["user_id"])
