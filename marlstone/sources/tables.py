"""Tables of a data set, and round trips through the file formats that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources.shared import new_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

#: format: options for writing and reading.
FORMATS: dict[str, dict[str, str]] = {
    "parquet": {},
    "orc": {},
    "json": {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    "csv": {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "escape": '"'},
    "xml": {"rowTag": "row", "rootTag": "rows", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
}

#: Rows of a file in a format whose files Spark reads whole; others are read in parts.
ROWS_A_FILE = {"xml": 200_000}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def views(spark: SparkSession, **frames: DataFrame) -> Iterator[None]:
    """Temporary views for the SQL text that is read herein; the user's own of these names are there again after.

    Spark resolves names when a text is read, so its result doesn't need them any longer.
    """
    held = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name in frames}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name in frames:
            if name in held:
                held[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def over_tables(spark: SparkSession, sf_dir: str, text: str, *names: str, **options) -> DataFrame:
    """The result of SQL text over tables of the data set, by their names."""
    with views(spark, **{name: load(spark, sf_dir, name) for name in names}):
        return spark.sql(text, **options)


def written(df: DataFrame, form: str, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder in a format and read again with the same schema.

    Where one task reads a file whole, a file holds a bounded number of rows (``ROWS_A_FILE``).
    """
    path = new_path(df.sparkSession, f"written-{form}")
    writer = df.write.format(form).options(**FORMATS[form])
    if form in ROWS_A_FILE:
        writer = writer.option("maxRecordsPerFile", ROWS_A_FILE[form])
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return df.sparkSession.read.format(form).options(**FORMATS[form]).schema(df.schema).load(path)


def as_lines(df: DataFrame, column: str) -> DataFrame:
    """A string column written as text files and read again, one row per line."""
    path = new_path(df.sparkSession, "written-text")
    df.select(column).write.text(path)
    return df.sparkSession.read.text(path)


def binary_files(df: DataFrame, column: str) -> DataFrame:
    """A string column written as text files, and these read as binary: path, length, content.

    Spark reads a binary file whole, so each of these holds a bounded number of lines.
    """
    path = new_path(df.sparkSession, "written-binary")
    df.select(column).write.option("maxRecordsPerFile", 1_000_000).text(path)
    return df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length", "content")
