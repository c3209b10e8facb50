"""Upserts, timers, sketches and databases on hand-made rows."""

import glob
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators.sketches import count_min, estimated
from marlstone.sources.jdbc import even_cuts, from_database, into_database
from marlstone.sources.upserts import upsert
from marlstone.streaming.timers import merged_spans


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=*/*.parquet")}


def test_upsert_touches_only_what_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, "abc"[i % 3] if i % 10 else None, f"v{i}") for i in range(60)] + [(900, "only", "x")]
    spark.createDataFrame(rows, "k int, part string, v string").repartition("part").write.partitionBy("part").parquet(path)
    before = files(path)
    changes = [
        (1, "b", "new", False, 1), (1, "b", "newer", False, 2),  # the last counts
        (4, "b", None, True, 1), (7, "d", "moved", None, 1),  # deleted; moved to a new partition
        (1000, "b", "added", False, 1), (None, "b", "no key", False, 1), (5000, "b", None, True, 1),  # deleted, never there
        (900, None, None, True, 1),  # the only row of its partition
    ]
    upsert(spark, path, spark.createDataFrame(changes, "k int, part string, v string, gone boolean, at int"), "k", "part", "gone", "at")
    want = {r[0]: r for r in rows if r[0] not in (1, 4, 7, 900)} | {1: (1, "b", "newer"), 7: (7, "d", "moved"), 1000: (1000, "b", "added"), None: (None, "b", "no key")}
    got = [(r.k, r.part, r.v) for r in spark.read.parquet(path).collect()]
    assert sorted(got, key=str) == sorted(want.values(), key=str)
    after = files(path)
    untouched = {f: t for f, t in before.items() if "part=a/" in f or "part=c/" in f}
    assert untouched and untouched.items() <= after.items()
    assert not any("part=only" in f for f in after) and not set(before) & {f for f in after if "part=b/" in f}
    upsert(spark, path, spark.createDataFrame(changes[:-1], "k int, part string, v string, gone boolean, at int").filter("k is not null"), "k", "part", "gone", "at")
    assert sorted(((r.k, r.part, r.v) for r in spark.read.parquet(path).collect()), key=str) == sorted(want.values(), key=str)


def test_upsert_of_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", "v")], "k int, part string, v string").write.partitionBy("part").parquet(path)
    before = files(path)
    upsert(spark, path, spark.createDataFrame([], "k int, part string, v string, gone boolean, at int"), "k", "part", "gone", "at")
    assert files(path) == before


def test_spans_merge():
    assert merged_spans([(5, 5, 1), (0, 0, 1), (9, 9, 1), (20, 25, 3), (24, 24, 1)], 5) == [(0, 0, 1), (5, 9, 2), (20, 25, 4)]
    assert merged_spans([], 5) == []


def test_timers_over_batches_and_late_rows(spark, tmp_path):
    """Sessions are reported once, whole, also if their rows come in several batches out of order."""
    from marlstone.streaming.runs import drained, rocksdb_state
    from marlstone.streaming.timers import closed_sessions

    batches = [[("a", 0), ("a", 30), ("b", 10)], [("a", 50), ("a", 20)], [("b", 400), ("a", 500)], [("a", 10), ("b", 900)], [("a", 15), ("c", 950)]]
    for own in batches:
        rows = spark.createDataFrame([(k, m) for k, m in own], "k string, m int").selectExpr("k", "cast(timestamp_seconds(6000000 + m * 60) AS timestamp_ntz) AS ts")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema("k string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    with rocksdb_state(spark):
        got = drained(closed_sessions(timed, "k", "ts", 40 * 60_000), "timers-test").collect()
    minutes = sorted((r.k, r.first_us // 60_000_000 - 100_000, r.last_us // 60_000_000 - 100_000, r.n) for r in got)
    # rows are late by the watermark of the batch before: minute 10 still counts, minute 15 does not; the last sessions are still open
    assert minutes == [("a", 0, 50, 5), ("a", 500, 500, 1), ("b", 10, 10, 1), ("b", 400, 400, 1)]


def test_count_min_bounds(spark):
    rng = random.Random(1)
    items = [int(rng.paretovariate(1.1)) for _ in range(4000)] + [None] * 5
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(items)], "g int, v int")
    exact = df.filter("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n_exact"))
    got = estimated(count_min(df, ["g"], "v", 256, 4), exact, ["g"], "v", 256, 4).collect()
    assert len(got) == exact.count() and all(r.estimate >= r.n_exact for r in got)
    assert sum(r.estimate > r.n_exact + 2000 * 2.72 / 256 for r in got) <= 0.05 * len(got)
    none = estimated(count_min(df, ["g"], "v"), spark.createDataFrame([(0, -7)], "g int, v int"), ["g"], "v").first()
    assert none.estimate <= 2


def test_parts_of_a_skewed_key_are_even(spark):
    """Nine in ten keys lie in a thousandth of the range; null keys are read once; filters reach the database."""
    url = "jdbc:derby:memory:skewed;create=true"
    keys = [*range(9000), *range(10_000, 9_000_000, 9_000), None, None]
    into_database(spark.createDataFrame([(k, f"s{(k or 0) % 3}") for k in keys], "k long, s string").coalesce(1), url, "SKEWED", "s VARCHAR(8)")
    read = from_database(spark, url, "SKEWED", '"k"', 4)
    parts = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert read.rdd.getNumPartitions() >= 2 and sum(parts) == len(keys)
    assert sorted(((r.k, r.s) for r in read.collect()), key=str) == sorted(((k, f"s{(k or 0) % 3}") for k in keys), key=str)
    plan = read.filter("k < 100 AND s = 's1'").select("s")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(k,100)" in plan and "EqualTo(s,s1)" in plan
    cuts = even_cuts(spark, url, "SKEWED", '"k"', 4, cells=100_000)
    held = [sum(lo <= (k or 0) < hi for k in keys) for lo, hi in zip([-1, *cuts], [*cuts, 10**9])]
    assert len(held) == 4 and max(held) < 1.2 * len(keys) / 4


@pytest.mark.parametrize("keys", [[], [5], [3] * 50, [-7, -6, -5, 0, 1]])
def test_odd_keys(spark, keys):
    url = f"jdbc:derby:memory:odd{len(keys)};create=true"
    into_database(spark.createDataFrame([(k,) for k in keys], "k long").coalesce(1), url, "ODD")
    assert sorted(r.k for r in from_database(spark, url, "ODD", '"k"', 3).collect()) == sorted(keys)


def test_sessions_stay_as_they_are(spark, small):
    """Views and settings of the user's are there again after queries that use such names."""
    from marlstone.plans.all import QUERIES

    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.range(3).createOrReplaceTempView("customer")
    try:
        assert QUERIES["sql_text"](spark, small).count() > 0 and QUERIES["recursion"](spark, small).count() > 0
        assert spark.table("customer").columns == ["id"] and spark.conf.get(key) == before
    finally:
        spark.catalog.dropTempView("customer")
    assert QUERIES["udf_table"](spark, small).count() > 0
    assert "nation" not in {t.name for t in spark.catalog.listTables() if t.isTemporary}


def test_spans_of_times_are_those_of_rows():
    from marlstone.streaming.timers import spans_of

    times = [20, 0, 4, 9, 9, 30, 34]
    assert spans_of(np.array(times), 5) == merged_spans([(t, t, 1) for t in times], 5) == [(0, 4, 2), (9, 9, 2), (20, 20, 1), (30, 34, 2)]
    assert spans_of(np.array([], dtype="int64"), 5) == []


def test_a_key_has_one_timer():
    """All sessions that the watermark has passed go at once; the timer is set for the first of the others."""
    from types import SimpleNamespace

    from marlstone.streaming.timers import _Sessions

    timers, kept = set(), []
    sessions = _Sessions("k", 5)
    sessions.handle = SimpleNamespace(listTimers=lambda: list(timers), registerTimer=timers.add, deleteTimer=timers.discard)
    sessions.open = SimpleNamespace(get=lambda: kept[-1] if kept else None, update=kept.append, clear=kept.clear)
    for times in ([40_000, 0, 1000, 20_000], [2000, 60_000]):
        assert list(sessions.handleInputRows(("a",), iter([pd.DataFrame({"at_us": times})]), None)) == [] and len(timers) == 1
    assert timers == {7}
    # 25 ms: the session that ends at 20 is due at 25, which the watermark has reached and not passed
    for mark, firsts, left in ((25, [0], {25}), (46, [20_000, 40_000], {65}), (66, [60_000], set())):
        due = timers.pop()
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        (out,) = sessions.handleExpiredTimer(("a",), at, SimpleNamespace(getExpiryTimeInMs=lambda due=due: due))
        assert out["first_us"].tolist() == firsts and timers == left
    assert not kept


def test_xml_files_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Spark reads an XML file whole in one task."""
    from marlstone.sources import tables

    monkeypatch.setattr(tables, "ROWS_A_FILE", {"xml": 10})
    read = tables.written(spark.range(35).coalesce(1), "xml")
    assert len(read.inputFiles()) == 4 and sorted(r.id for r in read.collect()) == list(range(35))
