"""Packing: cost-balanced assignment of documents to training sequences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, table
from marlstone.llm.tokens import default_vocabulary, encoder, text_slices

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Assign pieces of at most ``capacity`` tokens to as few sequences as can hold them.

    Pieces go in descending order, each to the sequence of lowest cost so far that still has room
    for it; a piece that fits nowhere whole is cut to fill the sequences of lowest cost. So all
    sequences but for the room of less than one are full.

    Returns (piece, start in the piece, length, sequence, offset), in the order of placing.
    """
    sequences = int(-(-int(lengths.sum()) // capacity))
    room = np.full(sequences, capacity, dtype=np.int64)
    cost = np.zeros(sequences)
    placed: list[tuple[int, int, int, int, int]] = []

    def put(piece: int, start: int, length: int, sequence: int) -> None:
        placed.append((piece, start, length, sequence, capacity - int(room[sequence])))
        room[sequence] -= length
        cost[sequence] += linear * length + quadratic * length * length

    uncut = []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        best = int(np.argmin(np.where(room >= length, cost, np.inf)))
        if room[best] >= length:
            put(piece, 0, length, best)
        else:
            uncut.append(piece)
    for piece in uncut:
        start, length = 0, int(lengths[piece])
        while start < length:
            best = int(np.argmin(np.where(room > 0, cost, np.inf)))
            part = min(int(room[best]), length - start)
            put(piece, start, part, best)
            start += part
    return placed


class _Window:
    """Documents of one partition that are packed together; bounded in pieces and tokens."""

    def __init__(self, capacity: int, linear: float, quadratic: float, next_sequence: int):
        self.capacity, self.linear, self.quadratic, self.next_sequence = capacity, linear, quadratic, next_sequence
        self.rows: list[tuple] = []
        self.rests: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens, step = len(ids) // 4, self.capacity
        whole = tokens - tokens % step
        for start in range(0, whole, step):
            cost = self.linear * step + self.quadratic * step * step
            self.rows.append((doc_id, start, step, ids[4 * start : 4 * (start + step)], tokens, self.next_sequence, 0, cost))
            self.next_sequence += 1
        if whole < tokens:
            self.rests.append((doc_id, whole, ids[4 * whole :], tokens))
        self.held += len(ids)

    def flush(self) -> pa.RecordBatch | None:
        if self.rests:
            lengths = np.array([len(r[2]) // 4 for r in self.rests], dtype=np.int64)
            for piece, start, length, sequence, offset in balance(lengths, self.capacity, self.linear, self.quadratic):
                doc_id, first, ids, tokens = self.rests[piece]
                cost = self.linear * length + self.quadratic * length * length
                own = ids[4 * start : 4 * (start + length)]
                self.rows.append((doc_id, first + start, length, own, tokens, self.next_sequence + sequence, offset, cost))
            self.next_sequence += int(-(-int(lengths.sum()) // self.capacity))
        rows, self.rows, self.rests, self.held = self.rows, [], [], 0
        return _batch(rows) if rows else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _pack(
    batches: Iterator[pa.RecordBatch],
    vocabulary: str,
    end_id: int,
    capacity: int,
    linear: float,
    quadratic: float,
    window_pieces: int,
    window_bytes: int,
    specials_are_text: bool,
) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    words = encoder(vocabulary, specials_are_text)
    end = np.array([end_id], dtype="<u4").tobytes()
    window = _Window(capacity, linear, quadratic, TaskContext.get().partitionId() << 40)
    for batch in batches:
        for part in text_slices(batch, 1):
            for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                window.add(doc_id, ids + end)
                if len(window.rests) >= window_pieces or window.held >= window_bytes:
                    if (out := window.flush()) is not None:
                        yield out
    words.forget()
    if (out := window.flush()) is not None:
        yield out


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    vocabulary: str | None = None,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    window_pieces: int = 8192,
    window_bytes: int = 16_000_000,
    specials_are_text: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Every text is encoded whole and closed with ``end_id``. Stretches of ``capacity`` tokens make
    sequences of their own; the rests of up to ``window_pieces`` documents of a partition (or
    ``window_bytes`` of ids) are packed together by :func:`balance`, so that attention cost,
    ``linear`` * length + ``quadratic`` * length squared for each piece, is even over sequences.
    Each window leaves less than one sequence of padding. Nothing is shuffled, and a task holds one
    window at a time. With ``specials_are_text``, added tokens of the vocabulary that occur in a text
    are encoded like any text; without, they give their own ids, as by the library's default.

    Returns one row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, cost. A null or empty text is its end id alone; texts of any
    length are encoded whole; null and repeated doc_ids are packed row by row; columns other than
    doc_id and text play no part, whatever their names; an empty table gives no rows.
    """
    pack = partial(
        _pack,
        vocabulary=vocabulary or default_vocabulary(),
        end_id=end_id,
        capacity=capacity,
        linear=linear,
        quadratic=quadratic,
        window_pieces=window_pieces,
        window_bytes=window_bytes,
        specials_are_text=specials_are_text,
    )
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a CRC-32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all ``documents`` into sequences of 2048 tokens, with the ids of the library's default."""
    return piece_digests(pack_documents(table(spark, sf_dir, "documents")))
