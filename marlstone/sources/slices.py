"""A data source in Python: a Parquet table read by its row groups, one task for each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class RowGroup(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class TableSlices(DataSource):
    """``spark.read.format("table_slices").schema(...).load(path)``; the schema names the columns to read."""

    @classmethod
    def name(cls) -> str:
        return "table_slices"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RowGroupReader(self.options["path"], schema)


class RowGroupReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        from pyarrow import dataset

        return [
            RowGroup(fragment.path, group.id)
            for fragment in dataset.dataset(self.path, format="parquet").get_fragments()
            for group in fragment.row_groups
        ]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        names, target = [f.name for f in self.schema.fields], to_arrow_schema(self.schema)
        for batch in pq.ParquetFile(partition.path).iter_batches(row_groups=[partition.number], columns=names):
            yield from pa.Table.from_batches([batch]).select(names).cast(target).to_batches()
