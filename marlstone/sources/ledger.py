"""A data source in Python for batches and streams: Parquet files that count once a ledger names them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import DoubleType, FloatType, StructType


class Folder:
    """The files of a table: `data` holds parts of any state, `ledger` one entry for each commit, in order."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)

    def entries(self) -> list[str]:
        from pyarrow import fs

        found = self.store.get_file_info(fs.FileSelector(f"{self.root}/ledger", allow_not_found=True))
        return sorted(f.path for f in found if f.path.endswith(".json"))

    def files(self, start: int = 0, end: int | None = None) -> list[str]:
        """Parts that the commits from ``start`` to ``end`` name."""
        out: list[str] = []
        for entry in self.entries()[start:end]:
            with self.store.open_input_stream(entry) as held:
                out += [f"{self.root}/data/{name}" for name in json.loads(held.read())]
        return out

    def write(self, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> str:
        """First phase, in a task: a part of a new name, which no ledger names yet; no rows make no part."""
        import pyarrow.parquet as pq

        name, writer = f"{uuid.uuid4().hex}.parquet", None
        self.store.create_dir(f"{self.root}/data", recursive=True)
        try:
            for batch in batches:
                if batch.num_rows:
                    writer = writer or pq.ParquetWriter(f"{self.root}/data/{name}", schema, filesystem=self.store)
                    writer.write_table(pa.Table.from_batches([batch]).cast(schema))
        finally:
            if writer:
                writer.close()
        return name if writer else ""

    def commit(self, names: list[str], writer: str, number: int | str) -> None:
        """Second phase, on the driver: one entry that appears whole. A batch that has one is not entered again."""
        known, mine = self.entries(), f"-{writer}-{number}.json"
        if any(entry.endswith(mine) for entry in known):
            return self.drop(names)
        self.store.create_dir(f"{self.root}/ledger", recursive=True)
        entry = f"{self.root}/ledger/{len(known):012d}{mine}"
        with self.store.open_output_stream(f"{entry}.new") as out:
            out.write(json.dumps(sorted(filter(None, names))).encode())
        self.store.move(f"{entry}.new", entry)

    def drop(self, names: Iterable[str]) -> None:
        for name in filter(None, names):
            self.store.delete_file(f"{self.root}/data/{name}")


@dataclass
class Part(InputPartition):
    file: str


@dataclass
class Written(WriterCommitMessage):
    name: str


class Ledger(DataSource):
    """``format("ledger")``: ``load(path)`` and ``save(path)``, in batches and streams.

    The schema must be given to read. With the option ``pushdown``, batch reads take filters on columns
    that are no floats into the scan; Spark asks for spark.sql.python.filterPushdown.enabled then. Writes are two-phase: tasks write
    parts, the driver enters them; parts of failed or repeated batches are never read. The option
    ``writer`` names a stream across restarts, so that a batch which runs again after a failure counts
    once. One writer at a time; the folder must be reachable by pyarrow from all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def reader(self, schema: StructType) -> DataSourceReader:
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (PushingReader if pushes else LedgerReader)(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LedgerStreamReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a ledger only grows: use mode append")
        return LedgerWriter(self.options["path"], schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return LedgerStreamWriter(self.options["path"], schema, self.options.get("writer", "stream"))


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _rows(path: str, file: str, schema: StructType, where=None) -> Iterator[pa.RecordBatch]:
    from pyarrow import dataset

    names, target = [f.name for f in schema.fields], _arrow(schema)
    held = dataset.dataset(file, format="parquet", filesystem=Folder(path).store)
    for batch in held.to_batches(columns=names, filter=where):
        yield from pa.Table.from_batches([batch]).select(names).cast(target).to_batches()


class LedgerReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.tests = path, schema, []

    def partitions(self) -> list[Part]:
        return [Part(f) for f in Folder(self.path).files()]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        # without any part Spark reads once, of none
        return _rows(self.path, partition.file, self.schema, self._where()) if partition else iter(())

    def _where(self):
        return None


class PushingReader(LedgerReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what the scan decides as Spark would; NaN makes floats differ. The rest is given back."""
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for test in filters:
            column = getattr(test, "attribute", ())
            plain = isinstance(test, (EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, IsNull, LessThan, LessThanOrEqual))
            if plain and len(column) == 1 and not isinstance(kinds.get(column[0]), (DoubleType, FloatType, type(None))):
                self.tests.append(test)
            else:
                yield test

    def _where(self):
        from pyarrow import dataset

        def one(test: Filter):
            held = dataset.field(test.attribute[0])
            if isinstance(test, IsNull):
                return held.is_null()
            if isinstance(test, IsNotNull):
                return held.is_valid()
            if isinstance(test, In):
                return held.isin([v for v in test.value if v is not None])
            compare = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
            return getattr(held, compare[type(test)])(test.value)

        return reduce(lambda a, b: a & b, map(one, self.tests)) if self.tests else None


class LedgerStreamReader(DataSourceStreamReader):
    """Offsets are numbers of commits, so a batch that is planned again has the same rows."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(Folder(self.path).entries())}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(f) for f in Folder(self.path).files(start["commits"], end["commits"])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition.file, self.schema)


class _Writer:
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(Folder(self.path).write(iterator, _arrow(self.schema)))


class LedgerWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        Folder(self.path).commit([m.name for m in messages if m], "batch", uuid.uuid4().hex)

    def abort(self, messages: list[Written | None]) -> None:
        Folder(self.path).drop(m.name for m in messages if m)


class LedgerStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: StructType, writer: str):
        super().__init__(path, schema)
        self.writer = writer

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        Folder(self.path).commit([m.name for m in messages if m], self.writer, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        Folder(self.path).drop(m.name for m in messages if m)
