"""Upserts into a partitioned Parquet table: copy on write of the partitions that change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.shared import new_path, remove, staged

#: Partition values that go into the filter of a scan; more are joined.
MOST_LISTED = 1_000


def _of(table: DataFrame, partition: str, values: DataFrame) -> DataFrame:
    """Rows of ``table`` whose partition is among ``values``; only their folders are read."""
    listed = [r[0] for r in values.limit(MOST_LISTED + 1).collect()]
    if len(listed) > MOST_LISTED:
        return table.join(values, table[partition].eqNullSafe(values[values.columns[0]]), "left_semi")
    known = [v for v in listed if v is not None]
    match = F.col(partition).isin(known) if known else F.lit(False)
    return table.filter(match | F.col(partition).isNull() if None in listed else match)


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str, partition: str, deleted: str, order: str) -> None:
    """Apply ``changes`` to the table at ``path``, written with ``partitionBy(partition)``: insert, update, move, delete.

    Changes have the table's columns, ``deleted`` (whether the row of ``key`` goes) and ``order``; of several
    changes to one key the last in order counts. Only partitions that lose or gain a row are read whole
    and written anew, the others' files stay as they are. The new rows are complete in the shared folder
    before the first old file goes; a run that fails while they are put in place can be repeated, as
    the outcome doesn't depend on how often changes are applied. Partitions without rows are removed.
    Null keys match nothing and are inserted; rows of the table that share a key are all replaced by one.
    One writer at a time.
    """
    table = spark.read.parquet(path)
    columns = table.columns
    fields = [F.col(c) for c in changes.columns]
    known = changes.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*fields), order).alias("_last"))
    last = known.select("_last.*").unionByName(changes.filter(F.col(key).isNull()))
    last = staged(last.select(*columns, F.coalesce(F.col(deleted), F.lit(False)).alias("_gone")), "upsert-changes")
    keys = last.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"))
    left = table.select(key, partition).join(keys, F.col(key) == F.col("_key"), "left_semi").select(partition)
    touched = staged(left.unionByName(last.filter("NOT _gone").select(partition)).distinct(), "upsert-touched")
    kept = _of(table, partition, touched).join(keys, F.col(key) == F.col("_key"), "left_anti")
    rows = kept.select(*columns).unionByName(last.filter("NOT _gone").select(*columns))
    fresh = new_path(spark, "upsert-rows")
    # one shuffle gathers what goes into a partition, in as many files as its size asks for
    rows.repartition(partition, F.pmod(F.xxhash64(key), F.lit(16))).write.partitionBy(partition).parquet(fresh)
    schema = table.schema
    written = spark.read.schema(schema).parquet(fresh)
    written.write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    empty = touched.join(written.select(F.col(partition).alias("_held")).distinct(), F.col(partition).eqNullSafe(F.col("_held")), "left_anti")
    names = {r[0] for r in empty.collect()}
    for folder in _folders(spark, path):
        if names and folder.split("=", 1)[1] in {"__HIVE_DEFAULT_PARTITION__" if n is None else str(n) for n in names}:
            remove(spark, f"{path}/{folder}")
    remove(spark, fresh)


def _folders(spark: SparkSession, path: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return [f.getPath().getName() for f in found if f.isDirectory() and "=" in f.getPath().getName()]
