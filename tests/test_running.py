"""Running values over hot keys and overlap joins, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators.joins import asof_join, overlap_join
from marlstone.operators.running import Running, running
from marlstone.sources.tables import TABLES
from marlstone.streaming.runs import drained, stream_of
from tests.test_plans import rows as plain_rows


def plain(rows, kind, strict):
    """rows: (key, time, id, value), in order."""
    out, seen = {}, []
    for _, _, i, v in rows:
        if not strict and v is not None:
            seen.append(v)
        fold = {"last": lambda x: x[-1], "sum": sum, "count": len, "min": min, "max": max}[kind]
        out[i] = fold(seen) if seen or kind == "count" else None
        if strict and v is not None:
            seen.append(v)
    return out


def some_rows():
    rng = random.Random(5)
    rows = [("hot", rng.randint(0, 90), i, rng.choice([None, *range(9)])) for i in range(400)]
    rows += [(None, rng.randint(0, 30), 1000 + i, i) for i in range(150)]
    rows += [(f"k{i % 40}", rng.randint(0, 50), 2000 + i, i) for i in range(300)]
    rows += [("hot", None, 3000, 5), ("hot", None, 3001, None), ("one", 1, 3002, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("up", [True, False])
def test_running_equals_a_loop(spark, up):
    rows = some_rows()
    df = spark.createDataFrame(rows, "k string, t int, id long, v int").repartition(5)
    kinds = [(k, s) for k in ("last", "sum", "count", "min", "max") for s in (False, True)]
    values = {f"{k}_{s}": Running(k, "v", s) for k, s in kinds}
    got = {r.id: r for r in running(df, ["k"], [("t", up), ("id", True)], values, pieces=7, hot_rows=50).collect()}
    assert len(got) == len(rows)
    by_key = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    for own in by_key.values():
        own.sort(key=lambda r: (r[1] is not None, (r[1] or 0) if up else -(r[1] or 0), r[2]))
        for kind, strict in kinds:
            for i, want in plain(own, kind, strict).items():
                assert got[i][f"{kind}_{strict}"] == want, (kind, strict, i)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 9, 16, 17, 40])
def test_pieces_by_any_number_of_cuts(spark, monkeypatch, n):
    import marlstone.operators.running as module

    monkeypatch.setattr(module, "MOST_COMPARED", 3)
    cuts = [3 * i for i in range(n)]
    df = spark.createDataFrame([(i,) for i in range(-2, 3 * n + 3)] + [(None,)], "t int")
    for r in df.select("t", module._piece(F.col("t"), cuts).alias("p")).collect():
        assert r.p == (0 if r.t is None else sum(c < r.t for c in cuts))


def test_hot_key_is_spread(spark):
    """A key with nearly all rows goes to many partitions, each with a fair share."""
    df = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = running(df, ["k"], [("t", True)], {"s": Running("sum", "v")}, pieces=8, hot_rows=1000)
        held = [r["count"] for r in done.filter("k = -1").groupBy(F.spark_partition_id()).count().collect()]
        assert "SinglePartition" not in done._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(held) == 19_600 and len(held) > 2
    assert done.filter("t = 19999").first().s == sum(i for i in range(20_000) if i % 50)


def test_running_refuses_and_empty(spark):
    df = spark.createDataFrame([], "k string, t int, v int")
    assert running(df, ["k"], [("t", True)], {"x": Running("sum", "v")}).columns == ["k", "t", "v", "x"]
    with pytest.raises(ValueError):
        Running("median", "v")
    with pytest.raises(ValueError):
        running(df, [], [("t", True)], {})


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_over_a_hot_key(spark, monkeypatch, direction, strict):
    import marlstone.operators.joins as joins

    monkeypatch.setattr(joins, "running", lambda *a: running(*a, pieces=6, hot_rows=20))
    rng = random.Random(7)
    left = [(rng.choice(["h"] * 5 + ["x", None]), rng.choice([None, *range(60)]), i) for i in range(300)]
    right = [(rng.choice(["h"] * 5 + ["x", "y", None]), rng.choice([None, *range(0, 60, 3)]), rng.randint(0, 99)) for _ in range(200)]
    got = {r.i: r.v for r in asof_join(
        spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, u int, v int"), "t", "u", ["k"], ["v"], direction, strict
    ).collect()}
    sign = 1 if direction == "backward" else -1
    for k, t, i in left:
        fits = [(sign * u, v) for rk, u, v in right if None not in (k, t, u) and rk == k and (sign * u < sign * t or u == t and not strict)]
        assert got[i] == (max(fits)[1] if fits else None)


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_overlaps_equal_a_nested_loop(spark, bits):
    rng = random.Random(bits)
    span = lambda: (lambda a, n: (a, a + n))(rng.randint(-5000, 5000), rng.choice([0, 1, 1, 2, 7, 64, 65, 300, 4096, 40_000]))
    left = [(i, *span()) for i in range(150)] + [(900, None, 5), (901, 5, None), (902, 9, 3), (903, -(2**61), 2**60)]
    right = [(i, *span()) for i in range(150)] + [(950, None, None), (951, -1, 0), (951, -1, 0), (952, -(2**60), 2**60)]
    got = overlap_join(
        spark.createDataFrame(left, "a int, a_low long, a_high long"), spark.createDataFrame(right, "b int, b_low long, b_high long"),
        ("a_low", "a_high"), ("b_low", "b_high"), bits,
    )
    want = sorted((a, b) for a, al, ah in left for b, bl, bh in right if None not in (al, ah, bl, bh) and al < ah and bl < bh and al < bh and bl < ah)
    assert sorted((r.a, r.b) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_long_spans_make_few_copies(spark):
    long = spark.createDataFrame([(i, 0, 10**12) for i in range(50)], "a int, a_low long, a_high long")
    short = spark.createDataFrame([(i, i * 1000, i * 1000 + 3) for i in range(1000)], "b int, b_low long, b_high long")
    pairs = overlap_join(long, short, ("a_low", "a_high"), ("b_low", "b_high"))
    assert pairs.count() == 50_000
    empty = overlap_join(long.limit(0), short, ("a_low", "a_high"), ("b_low", "b_high"))
    assert empty.count() == 0 and empty.columns == ["a", "a_low", "a_high", "b", "b_low", "b_high"]


def test_streams_read_folders(spark, small, tmp_path):
    """A table that Spark has written, as a folder of part files beside one whose name begins alike."""
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    events.limit(5).write.parquet(str(tmp_path / "events_old.parquet"))
    for folder in (str(tmp_path), small):
        got = drained(stream_of(spark, folder, "events").select("event_id"), "folder")
        assert got.count() == events.count()
    assert "events" in TABLES


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_own_state", "stream_processor", "stream_memory_sink"])
def test_stream_queries_over_folders(spark, small, tmp_path, name):
    from marlstone.plans.all import QUERIES

    for table in ("events", "customer", "nation"):
        spark.read.parquet(f"{small}/{table}.parquet").repartition(2).write.parquet(str(tmp_path / f"{table}.parquet"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert plain_rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == plain_rows(QUERIES[name](spark, small).toPandas())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_quantiles_equal_sorting(spark):
    import numpy as np

    from marlstone.operators.quantiles import exact_quantiles

    rng = random.Random(9)
    rows = [("hot", float(rng.choice([rng.randint(0, 20), rng.random() * 20]))) for _ in range(900)]
    rows += [(None, float(i * i)) for i in range(40)] + [("one", 5.0), ("none", None), ("some", None), ("some", -1.0), ("some", 2.0)]
    wanted = {f"q{int(s * 100)}{'c' if b else 'd'}": (s, b) for s in (0.0, 0.1, 0.5, 0.99, 1.0) for b in (True, False)}
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", wanted, pieces=6, hot_rows=100).collect()}
    assert set(got) == {"hot", None, "one", "none", "some"}
    for g, r in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        for name, (share, between) in wanted.items():
            want = np.quantile(own, share, method="linear" if between else "inverted_cdf") if own else None
            assert r[name] == (pytest.approx(want) if own else None), (g, name)
