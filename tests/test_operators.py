"""Operators on hand-made rows: nulls, ties, empty sides."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions.columns import half_up, ratio
from marlstone.operators.joins import asof_join, dealt_join, greater_join, not_in, range_join, skew_join, top_per_group


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_asof_takes_latest_not_after(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5), (None, 5), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), ("c", 1, 9), (None, 1, 8), ("a", None, 7)], "k string, u int, v int")
    got = found(asof_join(left, right, "t", "u", ["k"], ["v"]))
    assert got == sorted([("a", 5, 51), ("a", 1, None), ("b", 5, None), (None, 5, None), ("a", None, None)], key=str)


def test_asof_strict_and_forward(spark):
    left = spark.createDataFrame([("a", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 9, 90)], "k string, u int, v int")
    assert found(asof_join(left, right, "t", "u", ["k"], ["v"], strict=True)) == [("a", 5, 20)]
    assert found(asof_join(left, right, "t", "u", ["k"], ["v"], "forward")) == [("a", 5, 50)]
    assert found(asof_join(left, right, "t", "u", ["k"], ["v"], "forward", strict=True)) == [("a", 5, 90)]
    with pytest.raises(ValueError):
        asof_join(left, right, "t", "u", ["k"], ["v"], "sideways")


def test_asof_with_empty_right(spark):
    left = spark.createDataFrame([("a", 5)], "k string, t int")
    right = spark.createDataFrame([], "k string, u int, v int")
    assert found(asof_join(left, right, "t", "u", ["k"], ["v"])) == [("a", 5, None)]


def test_range_join_equals_nested_loop(spark):
    points = spark.createDataFrame([(float(i) / 3,) for i in range(-30, 60)] + [(None,)], "p double")
    ranges = spark.createDataFrame([(0.0, 2.5), (-7.0, 11.0), (3.0, 3.0), (2.5, 2.6), (None, 1.0)], "lo double, hi double")
    want = points.join(ranges, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi")))
    assert found(range_join(points, ranges, "p", "lo", "hi", 2)) == found(want.select("p", "lo", "hi"))


def test_salted_join_equals_plain(spark):
    large = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 0), (None, 0)], "k int, v int")
    small = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert found(skew_join(large, small, ["k"], how, 4)) == found(large.join(small, "k", how))
    with pytest.raises(ValueError):
        skew_join(large, small, ["k"], "full")


def test_dealt_join_spreads_the_pairs_of_a_key(spark):
    """One key of 300 rows by 200, one of 1 by 500, nulls and copies, in tiles of at most 64 pairs."""
    left = spark.createDataFrame([(1, n % 250) for n in range(300)] + [(2, 0), (3, 0), (None, 0)], "k int, a int")
    right = spark.createDataFrame([(1, n) for n in range(200)] + [(2, n % 400) for n in range(500)] + [(None, 1), (4, 1)], "k int, b int")
    got = dealt_join(left, right, ["k"], 64)
    assert got.columns == ["k", "a", "b"] and found(got) == found(left.join(right, "k"))
    spread = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 60 and max(r["count"] for r in spread) < 60_500 / 8
    assert found(dealt_join(left, right.limit(0), ["k"], 64)) == []


def test_greater_join_equals_nested_loop(spark, monkeypatch):
    monkeypatch.setattr("marlstone.operators.joins.dealt_join", lambda left, right, on: dealt_join(left, right, on, 64))
    nan, far = float("nan"), float("inf")
    left = spark.createDataFrame([(n % 3, n, float(n * 37 % 101)) for n in range(200)] + [(0, 900, None), (1, 901, nan), (1, 902, far), (None, 903, 5.0)], "k int, a int, x double")
    right = spark.createDataFrame([(n % 4, n, float(n * 53 % 97) + n % 2 / 2) for n in range(150)] + [(0, 950, None), (1, 951, nan), (1, 952, -far)], "k int, b int, y double")
    for cuts in (1, 7, 63):
        want = left.join(right, "k").filter("x > y").select("k", "a", "x", "b", "y")
        assert str(found(greater_join(left, right, ["k"], "x", "y", cuts))) == str(found(want))
    assert found(greater_join(left, right.limit(0), ["k"], "x", "y")) == []
    # copies of few values, and nothing in vain but within a stretch
    same = spark.createDataFrame([(0, n, 1.0) for n in range(50)], "k int, a int, x double")
    assert greater_join(same, right, ["k"], "x", "y").count() == same.join(right, "k").filter("x > y").count()


def test_salted_join_repeats_rows_of_hot_keys_only(spark):
    large = spark.createDataFrame([(1, 7)] * 40 + [(1, i) for i in range(20)] + [(2, 0), (3, 0)] + [(None, i) for i in range(30)], "k int, v int")
    small = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        hot = skew_join(large, small, ["k"], how, 4, hot_rows=10)
        assert hot.columns == large.join(small, "k", how).columns
        assert found(hot) == found(large.join(small, "k", how))
        assert "Generate" in hot._jdf.queryExecution().toString()
    # without a hot key nothing is repeated: Spark's estimate of the small side, by which it broadcasts, holds
    assert "Generate" not in skew_join(large, small, ["k"], "inner", 4)._jdf.queryExecution().toString()


def test_not_in_follows_nulls(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert found(not_in(rows, "a", spark.createDataFrame([(1,)], "b int"), "b")) == [(2,)]
    assert found(not_in(rows, "a", spark.createDataFrame([(1,), (None,)], "b int"), "b")) == []
    assert len(found(not_in(rows, "a", spark.createDataFrame([], "b int"), "b"))) == 3


def test_top_per_group_keeps_k(spark):
    rows = spark.createDataFrame([(g, v) for g in "ab" for v in range(5)], "g string, v int")
    got = found(top_per_group(rows, ["g"], [F.desc("v")], 2))
    assert got == [("a", 3, 2), ("a", 4, 1), ("b", 3, 2), ("b", 4, 1)]


def test_columns(spark):
    row = spark.range(1).select(ratio(F.lit(1), F.lit(0)).alias("a"), half_up(F.lit(0.25), 1).alias("b")).first()
    assert (row.a, row.b) == (None, 0.3)


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark reaches no window."""
    from marlstone.streaming.runs import drained

    schema = "ts timestamp_ntz, v int"
    batches = [["2024-01-01 00:00:00", "2024-01-01 05:00:00"], ["2024-01-01 06:00:00"], ["2024-01-01 00:10:00", "2024-01-01 09:00:00"]]
    for i, times in enumerate(batches):
        rows = spark.createDataFrame([(t, i) for t in times], "t string, v int").selectExpr("cast(t AS timestamp_ntz) AS ts", "v")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    counts = timed.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select(F.hour("window.start").alias("h"), "n")
    got = dict(found(drained(counts, "late")))
    assert got == {0: 1, 5: 1, 6: 1}
