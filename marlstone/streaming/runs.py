"""File streams over tables, event time, and runs until all that is there has been read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.sources.shared import new_path, setting


def stream_of(spark: SparkSession, sf_dir: str, name: str, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The table ``name`` as a file stream, new files as they come.

    A table may be one file or a folder of part files, as Spark writes it.
    ``event_time`` becomes a timestamp with time zone, as watermarks ask for, with a watermark of ``delay``.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        stream = reader.parquet(f"{sf_dir}/{name}.parquet")
    else:
        stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    if event_time is None:
        return stream
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)


def drained(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run ``stream`` over all files there are, and read what it wrote to the shared folder.

    Batches are written by their number, so one that runs again after a failure replaces its own
    rows. In update mode the last row of each of ``keys`` counts, in complete mode the last batch.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, f"{name}-out"), new_path(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(out).drop("part")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.filter(F.col("batch") == last)
    elif mode == "update":
        others = [c for c in rows.columns if c not in (*keys, "batch")]
        newest = F.max_by(F.struct(*others), "batch").alias("newest")
        return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*")
    return rows.drop("batch")


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Count and largest ``value`` of every key so far, kept as state of our own; nulls count as rows only."""

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, most = state.get if state.exists else (0, float("-inf"))
        for rows in batches:
            known = rows[value].dropna()
            count, most = count + len(rows), max([most, *([float(known.max())] if len(known) else [])])
        state.update((count, most))
        yield pd.DataFrame({key: [keys[0]], "n": [count], "most": [most if most > float("-inf") else None]}).astype({"most": "Float64"})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, n long, most double", "n long, most double", "update", GroupStateTimeout.NoTimeout
    )


def rocksdb_state(spark: SparkSession) -> AbstractContextManager[None]:
    """Streams started herein keep their state in RocksDB, as stateful processors ask for; the session's setting comes back after."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    return setting(spark, "spark.sql.streaming.stateStore.providerClass", provider)


class _Kinds(StatefulProcessor):
    """Keeps the distinct values of a key in a map, and tells their number."""

    def __init__(self, key: str, value: str, value_type: str):
        self.key, self.value, self.value_type = key, value, value_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", f"value {self.value_type}", "n long")
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.total.get()[0] if self.total.exists() else 0
        for frame in rows:
            for value, n in frame[self.value].value_counts().items():
                before = self.seen.getValue((value,))[0] if self.seen.containsKey((value,)) else 0
                self.seen.updateValue((value,), (before + int(n),))
                known += before == 0
        self.total.update((known,))
        yield pd.DataFrame({self.key: [key[0]], "kinds": [known]})

    def close(self) -> None:
        pass


def distinct_values(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Number of distinct ``value`` of every key so far, by a stateful processor; it must run with :func:`rocksdb_state`."""
    kinds = dict(stream.dtypes)
    return stream.groupBy(key).transformWithStateInPandas(
        _Kinds(key, value, kinds[value]), f"{key} {kinds[key]}, kinds long", "Update", "None"
    )


def collected_in_memory(stream: DataFrame, mode: str) -> DataFrame:
    """Run ``stream`` into Spark's memory sink, for results that are small by nature, and give its table."""
    name = f"memory_{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)


def reordered(spark: SparkSession, sf_dir: str, name: str, event_time: str, order: str, delay: str = "1 hour", files: int = 8) -> DataFrame:
    """The table as a stream in which the later half by ``order``, in two batches, comes before the earlier half, in two more."""
    rows, path = spark.read.parquet(f"{sf_dir}/{name}.parquet"), new_path(spark, f"{name}-reordered")
    quarter = F.floor(F.col(order) * 4 / F.lit(rows.agg(F.max(order)).first()[0] + 1)).cast("int")
    for turn, own in enumerate((2, 3, 0, 1)):
        # files are read in the order of their writing, so many to a batch
        rows.filter(quarter == own).repartition(files).write.parquet(f"{path}/turn={turn}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/turn=*")
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)


Stream = Callable[[SparkSession, str], DataFrame]
