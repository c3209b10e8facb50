"""Tables that change, timers of stateful processors, and table functions over partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from marlstone.plans.registry import query
from marlstone.sources.ledger import Ledger
from marlstone.sources.shared import new_path, setting, staged
from marlstone.sources.tables import load, views
from marlstone.sources.upserts import upsert
from marlstone.streaming.runs import drained, rocksdb_state, stream_of
from marlstone.streaming.timers import closed_sessions


@query("""
SELECT o_orderkey, o_custkey, year, CASE WHEN touched THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
FROM (SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year,
             year(o_orderdate) = 1997 AND o_totalprice >= 200000 AS touched, o_orderpriority FROM orders)
WHERE NOT (year = 1997 AND o_orderpriority = '5-LOW')
UNION ALL
SELECT -c_custkey, c_custkey, 2002, c_acctbal FROM customer WHERE c_acctbal > 9000
""")
def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year, then dear ones of 1997 doubled, those of low priority deleted, and a new year's inserted."""
    orders = load(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    columns, path = ["o_orderkey", "o_custkey", "year", "o_totalprice"], new_path(spark, "orders-by-year")
    orders.select(*columns).repartition("year").write.partitionBy("year").parquet(path)
    of_year = orders.filter("year = 1997")
    dear = of_year.filter("o_totalprice >= 200000").select(
        "o_orderkey", "o_custkey", "year", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(False).alias("gone"), F.lit(1).alias("at")
    )
    low = of_year.filter("o_orderpriority = '5-LOW'").select(*columns, F.lit(True).alias("gone"), F.lit(2).alias("at"))
    rich = load(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(
        (-F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit(2002).alias("year"),
        F.col("c_acctbal").alias("o_totalprice"), F.lit(False).alias("gone"), F.lit(1).alias("at"),
    )
    upsert(spark, path, dear.unionByName(low).unionByName(rich), "o_orderkey", "year", "gone", "at")
    return spark.read.parquet(path).select(*columns)


@query("""
WITH marked AS (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events
), numbered AS (
    SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM marked
)
SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM numbered GROUP BY user_id, s
HAVING max(ts) + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions reported once, in append mode, by timers; those that the watermark has not passed are still open."""
    stream = stream_of(spark, sf_dir, "events", "ts").select("user_id", "ts")
    with rocksdb_state(spark):
        found = drained(closed_sessions(stream, "user_id", "ts", 6 * 3_600_000), "timers")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select("user_id", time("first_us").alias("began"), time("last_us").alias("ended"), "n")


class Funnel:
    """For each partition of rows in order of time, how many of the steps were taken one after the other, and when the last one was.

    ``analyze`` names the key's and the time's column and type as the table has them. State is a number
    and a time, so partitions of any size go through.
    """

    def __init__(self) -> None:
        self.done, self.key, self.at = 0, None, None

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, step: AnalyzeArgument, steps: AnalyzeArgument) -> AnalyzeResult:
        held = rows.dataType
        schema = StructType().add(held[key.value]).add("steps_done", IntegerType()).add("last_step", held[time.value].dataType)
        return AnalyzeResult(schema)

    def eval(self, rows: Row, key: str, time: str, step: str, steps: str) -> None:
        self.key, wanted = rows[key], steps.split(",")
        if self.done < len(wanted) and rows[step] == wanted[self.done]:
            self.done, self.at = self.done + 1, rows[time]

    def terminate(self) -> Iterator[tuple]:
        yield self.key, self.done, self.at


@query("""
WITH viewed AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY user_id),
clicked AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN viewed v ON e.user_id = v.user_id AND e.ts > v.t WHERE event_type = 'click' GROUP BY e.user_id),
bought AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN clicked c ON e.user_id = c.user_id AND e.ts > c.t WHERE event_type = 'purchase' GROUP BY e.user_id)
SELECT u.user_id, CAST((v.t IS NOT NULL)::INT + (c.t IS NOT NULL)::INT + (b.t IS NOT NULL)::INT AS INTEGER) AS steps_done, coalesce(b.t, c.t, v.t) AS last_step
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN viewed v USING (user_id) LEFT JOIN clicked c USING (user_id) LEFT JOIN bought b USING (user_id)
""")
def table_function_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a funnel of each user by a table function over partitions, in order of time."""
    spark.udtf.register("funnel_steps", F.udtf(Funnel))
    events = load(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    call = "SELECT * FROM funnel_steps(TABLE(events) PARTITION BY user_id ORDER BY (ts), 'user_id', 'ts', 'event_type', 'view,click,purchase')"
    with views(spark, events=events):
        return spark.sql(call)


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND user_id < 100")
def stream_custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a sink and a source of our own: written in two batches, streamed from the one to the other, read with filters in the scan."""
    spark.dataSource.register(Ledger)
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    first, second, state = (new_path(spark, f"ledger-{n}") for n in ("first", "second", "state"))
    for half in ("event_id % 2 = 0", "event_id % 2 <> 0 OR event_id IS NULL"):
        events.filter(half).write.format("ledger").mode("append").save(first)
    stream = spark.readStream.format("ledger").schema(events.schema).load(first)
    run = stream.writeStream.format("ledger").option("checkpointLocation", state).option("path", second).trigger(availableNow=True).start()
    run.awaitTermination()
    with setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
        read = spark.read.format("ledger").option("pushdown", "true").schema(events.schema).load(second)
        return staged(read.filter("event_type = 'purchase' AND user_id < 100").select("event_id", "user_id", "value"), "ledger-read")
