"""Token counts: a scan for end-of-document ids in flat, unindexed token files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, new_path, staged, table
from marlstone.llm.tokens import default_vocabulary, encoder, text_slices

#: Id that closes a document in the files of :func:`write_flat_files`; no text encodes to it.
END_ID = 49407
BLOCKS = "stream string, block long, payload binary"
SCANNED = "stream string, block long, tokens long, ends array<long>"
#: Blocks of a stream whose sums one task adds up.
CHUNK_BLOCKS = 1024


def write_flat_files(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, file_tokens: int = 1 << 28
) -> DataFrame:
    """Write documents to flat token files under ``path``, and give their names: (stream, ordinal, doc_id).

    A file holds little-endian unsigned 16-bit ids and nothing else; each document is followed by
    ``end_id``. Every partition writes files of its own, and begins a new one after ``file_tokens``.
    A file appears under its name when it is whole, so a task that runs again after a failure
    replaces its own files by equal ones. The names, which file and which document in it, are for
    those who want to know whose the counts are; the scan does not need them. Null and empty texts
    are their end id alone; texts of any length are encoded whole; null and repeated doc_ids are
    written row by row. Vocabularies must have fewer than 65,536 ids, and marks of theirs that occur
    in a text are text.
    """
    run = partial(_write, path=path, vocabulary=vocabulary or default_vocabulary(), end_id=end_id, file_tokens=file_tokens)
    spark = docs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    read = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(read.mapInArrow(run, "stream string, ordinal long, doc_id long"), "flat-names")


class _FlatFile:
    """A file being written under a name of the attempt's own."""

    def __init__(self, path: str, name: str, attempt: int):
        self.name, self.ordinal, self.tokens = name, 0, 0
        self._system, root = _file_system(f"{path.rstrip('/')}/")
        root = root.rstrip("/")
        self._system.create_dir(root, recursive=True)
        self._own, self._final = f"{root}/_{name}-{attempt}", f"{root}/{name}"
        self._out = self._system.open_output_stream(self._own)

    def add(self, ids: np.ndarray) -> int:
        self._out.write(ids.tobytes())
        self.tokens += len(ids)
        self.ordinal += 1
        return self.ordinal - 1

    def close(self) -> None:
        self._out.close()
        self._system.move(self._own, self._final)


def _write(batches: Iterator[pa.RecordBatch], path: str, vocabulary: str, end_id: int, file_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    words, task, number, out = encoder(vocabulary), TaskContext.get(), 0, None
    for batch in batches:
        for part in text_slices(batch, 1):
            names, ordinals = [], []
            for ids in words.encode(part.column(1).to_pylist()):
                if out is not None and out.tokens >= file_tokens:
                    out.close()
                    out, number = None, number + 1
                out = out or _FlatFile(path, f"part-{task.partitionId():05d}-{number:05d}", task.taskAttemptId())
                ordinals.append(out.add(np.append(np.frombuffer(ids, dtype="<u4"), np.uint32(end_id)).astype("<u2")))
                names.append(out.name)
            yield pa.record_batch(
                [pa.array(names, pa.string()), pa.array(ordinals, pa.int64()), part.column(0)], names=["stream", "ordinal", "doc_id"]
            )
    words.forget()
    if out is not None:
        out.close()


def _block(stream: str, block: int, ids: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary())
    return pa.record_batch(
        [pa.array([x], k) for x, k in zip((stream, block, ids.tobytes()), kinds, strict=True)],
        names=["stream", "block", "payload"],
    )


def read_flat_files(
    spark: SparkSession, path: str, token_bytes: int = 2, block_tokens: int = 1 << 18, task_bytes: int = 1 << 26
) -> DataFrame:
    """Flat token files under ``path`` as blocks for :func:`scan`; each file is one stream.

    Spark lists the files; their blocks are dealt to tasks of about ``task_bytes``, and each task
    seeks and reads one block at a time, so files may be of any size. Files are opened by pyarrow's
    file systems; of a store that those cannot open, Spark reads each file whole in one task.
    """
    size = token_bytes * block_tokens
    files = spark.read.format("binaryFile").load(path)
    listed = files.select("path", "length")
    first = listed.first()
    if first is not None and not _opens(first["path"]):
        return files.select("path", "content").mapInArrow(partial(_cut, size=size, token_bytes=token_bytes), BLOCKS)
    count = F.ceil(F.col("length") / size)
    blocks = listed.agg(F.sum(count)).first()[0] or 0
    places = listed.filter("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block")
    )
    # given a number, the tasks are not merged again for having few bytes in their places
    tasks = max(1, -(-int(blocks) // max(1, task_bytes // size)))
    return places.repartition(tasks).mapInArrow(partial(_read, size=size, token_bytes=token_bytes), BLOCKS)


def _file_system(path: str) -> tuple:
    """pyarrow's file system of a path as Spark spells it, and the path there."""
    from pyarrow import fs

    scheme, authority, rest = re.fullmatch(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(/.*)", path).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), rest
    system, root = fs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    return system, root.rstrip("/") + rest


def _opens(path: str) -> bool:
    try:
        system, place = _file_system(path)
        with system.open_input_file(place):
            return True
    except (AttributeError, OSError, ValueError, NotImplementedError):
        return False


def _read(batches: Iterator[pa.RecordBatch], size: int, token_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            system, place = _file_system(path)
            with system.open_input_file(place) as file:
                data = file.read_at(min(size, length - block * size), block * size)
            yield _block(path, block, np.frombuffer(data, dtype=f"<u{token_bytes}"))


def _cut(batches: Iterator[pa.RecordBatch], size: int, token_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            data = content.as_buffer()
            for block, at in enumerate(range(0, data.size, size)):
                ids = np.frombuffer(data.slice(at, min(size, data.size - at)), dtype=f"<u{token_bytes}")
                yield _block(name.as_py(), block, ids)


def _scan(batches: Iterator[pa.RecordBatch], end_id: int, token_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, ends = [], []
        for payload in batch.column(2):
            ids = np.frombuffer(payload.as_buffer(), dtype=f"<u{token_bytes}") if payload.is_valid else np.zeros(0)
            tokens.append(len(ids))
            ends.append(np.flatnonzero(ids == end_id))
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
            names=["stream", "block", "tokens", "ends"],
        )


def _based(sums: DataFrame) -> DataFrame:
    """For each block (stream, block, tokens, n, last) what comes before it in its stream.

    A prefix scan in two steps: within chunks of blocks, and over the sums of chunks; so no task
    holds more than a chunk's blocks or a stream's chunks.
    """
    within = W.partitionBy("stream", "chunk").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inner = (
        sums.withColumn("chunk", F.floor(F.col("block") / CHUNK_BLOCKS))
        .withColumn("in_base", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .withColumn("in_ordinal", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .withColumn("in_open", F.max(F.col("in_base") + F.col("last") + 1).over(within))
    )
    earlier = W.partitionBy("stream").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = (
        inner.groupBy("stream", "chunk")
        .agg(
            F.sum("tokens").alias("tokens"),
            F.sum("n").alias("n"),
            F.max(F.col("in_base") + F.col("last") + 1).alias("open"),
            F.max("block").alias("last_block"),
        )
        .withColumn("chunk_base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
        .select(
            "stream",
            "chunk",
            "chunk_base",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("chunk_ordinal"),
            F.max(F.col("chunk_base") + F.col("open")).over(earlier).alias("chunk_open"),
            F.max("last_block").over(W.partitionBy("stream")).alias("final_block"),
        )
    )
    return inner.join(chunks, ["stream", "chunk"]).select(
        "stream",
        "block",
        (F.col("chunk_base") + F.col("in_base")).alias("base"),
        (F.col("chunk_ordinal") + F.col("in_ordinal")).alias("ordinal"),
        F.coalesce(F.col("chunk_base") + F.col("in_open"), "chunk_open", F.lit(0)).alias("open_at"),
        (F.col("block") == F.col("final_block")).alias("final"),
    )


def scan(blocks: DataFrame, end_id: int = END_ID, token_bytes: int = 2) -> DataFrame:
    """Documents of flat token streams, found by their end ids.

    ``blocks`` has (stream, block, payload), as :func:`read_flat_files` gives them; blocks are numbered
    from 0 in each stream, and documents may run over any number of them. Each block is searched on
    its own; a prefix scan over the blocks' sums then gives each block its first place and ordinal in
    the stream and the start of the document that runs into it. Only one row of sums per block takes
    part in the scan; the ends themselves never leave their block.

    Returns one row per document: stream, ordinal, start (place in the stream), n_tokens (with the
    end id), closed. Tokens after the last end id form a last document that is not closed. Null
    payloads count as empty; empty streams and an empty table have no documents; documents may be of any
    length, and blocks of any that a task can hold; columns of other names play no part.
    """
    search = partial(_scan, end_id=end_id, token_bytes=token_bytes)
    found = staged(blocks.select("stream", "block", "payload").mapInArrow(search, SCANNED), "separators")
    last_end = F.try_element_at("ends", F.lit(-1))
    sums = found.select("stream", "block", "tokens", F.size("ends").cast("long").alias("n"), last_end.alias("last"))
    with_base = found.join(_based(sums), ["stream", "block"])
    closed = with_base.select(
        "stream", "base", "ordinal", "open_at", "ends", F.posexplode("ends").alias("nth", "end")
    ).select(
        "stream",
        (F.col("ordinal") + F.col("nth")).alias("ordinal"),
        F.when(F.col("nth") == 0, F.col("open_at"))
        .otherwise(F.col("base") + F.get("ends", F.col("nth") - 1) + 1)
        .alias("start"),
        (F.col("base") + F.col("end") + 1).alias("stop"),
        F.lit(True).alias("closed"),
    )
    left_open = with_base.filter("final").select(
        "stream",
        (F.col("ordinal") + F.size("ends")).alias("ordinal"),
        F.coalesce(F.col("base") + last_end + 1, F.col("open_at")).alias("start"),
        (F.col("base") + F.col("tokens")).alias("stop"),
        F.lit(False).alias("closed"),
    )
    return closed.unionByName(left_open.filter("stop > start")).select(
        "stream", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed"
    )


def count_tokens(docs: DataFrame, block_tokens: int = 1 << 18, file_tokens: int = 1 << 28) -> DataFrame:
    """Token counts of documents by a scan of flat files that are written first, in the shared folder.

    Returns one row per document: stream (its file), ordinal, start, n_tokens, closed, doc_id.
    """
    spark = docs.sparkSession
    path = new_path(spark, "flat-files")
    names = write_flat_files(docs, path, file_tokens=file_tokens)
    found = scan(read_flat_files(spark, path, block_tokens=block_tokens))
    return found.withColumn("stream", F.regexp_extract("stream", "[^/]*$", 0)).join(names, ["stream", "ordinal"])


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``, found in flat files of their ids."""
    return count_tokens(table(spark, sf_dir, "documents"))
