"""What the training-data operators share: table access and shared intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.shared import new_path, remove, shared_dir, staged
from marlstone.sources.tables import load as table

__all__ = ["bounded_batches", "new_path", "private", "quoted", "remove", "shared_dir", "sized", "staged", "table"]


def sized(keys: DataFrame, most_rows: int = 500_000, most_bytes: int = 64_000_000) -> DataFrame:
    """Narrow ``keys`` for a join: sent to all tasks up to ``most_rows`` rows and ``most_bytes``, else left to a shuffle.

    Rows and bytes are counted first, so give a written table.
    """
    held = [F.octet_length(f.name) for f in keys.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    bytes_held = F.sum(sum((F.coalesce(x, F.lit(0)).cast("long") for x in held), F.lit(8 * len(keys.columns)).cast("long")))
    rows, size = keys.agg(F.count(F.lit(1)), F.coalesce(bytes_held, F.lit(0))).first()
    return F.broadcast(keys) if rows <= most_rows and size <= most_bytes else keys


def private(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column's name as expressions take it, whatever dots and backticks it has."""
    return "`" + name.replace("`", "``") + "`"


def bounded_batches(df: DataFrame, most: str = "4m") -> DataFrame:
    """``df``, after the session's Arrow batches have been bounded to a few MB of texts.

    Spark's own bound of 64 MB costs that much in the JVM and again, decoded, in Python for each
    task. A session that sets its own bound keeps it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, most)
    return df
