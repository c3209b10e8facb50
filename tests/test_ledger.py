"""The data source of our own: two-phase writes, offsets, filters in the scan."""

import os

import pytest
from pyspark.sql import functions as F

from marlstone.sources.ledger import Folder, Ledger

SCHEMA = "k int, s string, x double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_failed_batch_leaves_no_rows(spark, tmp_path):
    spark.dataSource.register(Ledger)
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(1, "a", 1.0), (2, None, None)], SCHEMA)
    good.write.format("ledger").mode("append").save(path)
    # one task fails, the others have written their parts by then
    bad = spark.range(400).repartition(4).select(
        F.col("id").cast("int").alias("k"), F.when(F.col("id") == 399, F.raise_error(F.lit("no"))).otherwise("b").alias("s"), F.lit(0.0).alias("x")
    )
    with pytest.raises(Exception):
        bad.write.format("ledger").mode("append").save(path)
    read = spark.read.format("ledger").schema(SCHEMA).load(path)
    assert rows(read) == rows(good) and len(Folder(path).entries()) == 1
    spark.createDataFrame([], SCHEMA).write.format("ledger").mode("append").save(path)
    assert rows(spark.read.format("ledger").schema(SCHEMA).load(path)) == rows(good)
    assert spark.read.format("ledger").schema(SCHEMA).load(str(tmp_path / "none")).count() == 0


def test_streams_count_every_commit_once(spark, tmp_path):
    """A stream that stops in the middle and goes on; a batch that is committed twice counts once."""
    spark.dataSource.register(Ledger)
    first, second, state = (str(tmp_path / n) for n in ("first", "second", "state"))

    def flow():
        stream = spark.readStream.format("ledger").schema(SCHEMA).load(first)
        run = stream.writeStream.format("ledger").option("checkpointLocation", state).option("path", second).trigger(availableNow=True).start()
        run.awaitTermination()

    for i in range(3):
        spark.createDataFrame([(i, "s", 0.5), (10 + i, None, None)], SCHEMA).write.format("ledger").mode("append").save(first)
        if i != 1:
            flow()
    flow()
    want = rows(spark.read.format("ledger").schema(SCHEMA).load(first))
    assert len(want) == 6 and rows(spark.read.format("ledger").schema(SCHEMA).load(second)) == want
    folder = Folder(second)
    entries, files = folder.entries(), folder.files()
    # the driver dies after a commit, so the batch runs again with new parts
    import pyarrow as pa

    again = folder.write(iter([pa.record_batch([pa.array([1])], names=["k"])]), pa.schema([("k", pa.int64())]))
    folder.commit([again], "stream", 0)
    assert (folder.entries(), folder.files()) == (entries, files) and not os.path.exists(f"{second}/data/{again}")


def test_filters_reach_the_scan(spark, tmp_path):
    from marlstone.sources.ledger import PushingReader
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull
    from pyspark.sql.types import StructType

    spark.dataSource.register(Ledger)
    path, nan = str(tmp_path / "t"), float("nan")
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"s{i % 3}", nan if i % 5 == 0 else float(i)) for i in range(50)] + [(None, "s1", 1.0)], SCHEMA)
    df.write.format("ledger").mode("append").save(path)
    reader = PushingReader(path, StructType.fromDDL(SCHEMA))
    back = list(reader.pushFilters([EqualTo(("s",), "s1"), GreaterThan(("x",), 3.0), In(("k",), (1, 4, None)), IsNotNull(("k",))]))
    assert back == [GreaterThan(("x",), 3.0)]  # NaN is the largest in Spark, and nothing in Arrow
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["k"] for r in found] == [1, 4]
    reader = PushingReader(path, StructType.fromDDL(SCHEMA))
    assert list(reader.pushFilters([IsNull(("s",))])) == []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("ledger").option("pushdown", "true").schema(SCHEMA).load(path)
        for test in ("s = 's1' AND x > 30", "k IN (1, 2, 40)", "k >= 45", "s IS NULL", "x = double('NaN') AND k < 20", "k IS NOT NULL AND k <= 3", "s <> 's1'"):
            assert str(rows(read.filter(test))) == str(rows(df.filter(test))), test
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
