"""Ranked lexical search: hashed max-sketches give upper bounds, whole texts the exact scores of what may still rank."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from marlstone.llm.common import bounded_batches, new_path, private, quoted, sized, staged, table
from marlstone.llm.tokens import text_slices

#: Bytes that are no part of a term become blanks, A-Z become a-z.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or bytes([b]).isalnum() else 32 for b in range(256))
#: Bytes of text that are split at once.
STRETCH = 4_000_000
#: Occurrences that a sketch tells apart; this number stands for itself and all above.
MOST_TIMES = 255
#: What no impact of a term of weight 1 reaches.
LIMIT = 1_000_000


def terms_in(text: bytes | None) -> Iterator[list[bytes]]:
    """Terms of a text in stretches: runs of a-z, 0-9 and anything beyond ASCII, A-Z taken as a-z."""
    flat, start = (text or b"").translate(_TO_TERMS), 0
    while start < len(flat):
        end = flat.find(b" ", start + STRETCH) if len(flat) > start + STRETCH else -1
        end = len(flat) if end < 0 else end
        yield flat[start:end].split()
        start = end


def counted(text: bytes | None) -> Counter:
    """Occurrences of each term of a text."""
    found: Counter = Counter()
    for stretch in terms_in(text):
        found.update(stretch)
    return found


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A document's part of a term's score, in whole numbers; it grows with ``tf`` and is below ``LIMIT``."""
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


def length_factor(n: np.ndarray | int, documents: int, total: int) -> np.ndarray | int:
    """The contract's m of a document with ``n`` terms, of ``documents`` with ``total`` terms."""
    return 50 + (50 * n * documents) // total


class _Places(dict):
    """Coordinates of terms; starts anew when it has grown to ``most`` terms."""

    most = 200_000

    def __init__(self, coordinates: int):
        self.coordinates = coordinates

    def __missing__(self, term: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[term] = xxhash.xxh3_64_intdigest(term) % self.coordinates
        return value


def sketch(found: Counter, places: _Places) -> tuple[bytes, bytes]:
    """A document's max-sketch: the coordinates that its terms hash to, and the largest tf at each.

    Within a document impacts grow with tf alone, so the largest tf is that of the largest impact.
    """
    at = np.fromiter(map(places.__getitem__, found), "<u4", len(found))
    tf = np.minimum(np.fromiter(found.values(), np.int64, len(found)), MOST_TIMES).astype(np.uint8)
    order = np.lexsort((tf, at))
    at, tf = at[order], tf[order]
    last = np.append(at[1:] != at[:-1], True)
    return at[last].tobytes(), tf[last].tobytes()


def _index(batches: Iterator[pa.RecordBatch], schema: pa.Schema, coordinates: int) -> Iterator[pa.RecordBatch]:
    """Rows of four kinds: sketches of texts, ids of documents, partial df of terms, partial totals."""
    places, df, met = _Places(coordinates), Counter(), set()
    documents = total = 0

    def made(kind: str, **columns: pa.Array | list) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        held = [pa.array([kind] * size) if f.name == "kind" else columns.get(f.name, pa.nulls(size, f.type)) for f in schema]
        held = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(held, schema, strict=True)]
        return pa.record_batch([x.cast(f.type) for x, f in zip(held, schema, strict=True)], schema=schema)

    def terms() -> Iterator[pa.RecordBatch]:
        held = list(df)
        for at in range(0, len(held), 50_000):
            own = held[at : at + 50_000]
            yield made("term", term=own, n=[df[t] for t in own])
        df.clear()

    for batch in batches:
        for part in text_slices(batch, 2):
            yield made("document", doc_id=part.column(0), text_id=part.column(1))
            rows: list[tuple] = []
            for text_id, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                found = counted(text)
                if not found:
                    continue
                n = found.total()
                documents, total = documents + 1, total + n
                df.update(found.keys())
                if text_id not in met:
                    met.add(text_id)
                    rows.append((text_id, n, *sketch(found, places)))
            if rows:
                text_ids, n, at, tf = zip(*rows, strict=True)
                yield made("text", text_id=list(text_ids), n=list(n), places=list(at), times=list(tf))
            if len(df) > 300_000:
                yield from terms()
            if len(met) > 1_000_000:
                met.clear()
    yield from terms()
    yield made("totals", n=[documents, total], term=[b"documents", b"terms"])


@dataclass(frozen=True)
class LexicalIndex:
    """What :func:`index` has written of a table of texts, and the table."""

    docs: DataFrame
    sketches: DataFrame
    members: DataFrame
    vocabulary: DataFrame
    documents: int
    total: int
    coordinates: int


def _text_id(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coordinates: int = 1 << 20) -> LexicalIndex:
    """Fold every whole text into a max-sketch of ``coordinates``, kept sparse, and count df of all terms.

    One scan of the texts; what is written grows with their distinct terms. Equal texts share a
    sketch. Null texts have no term; rows of null or repeated id are documents of their own;
    columns of other names play no part.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(quoted(doc_id)).alias("doc_id"), _text_id(quoted(text)).alias("text_id"), F.col(quoted(text)).cast("binary").alias("text"))
    docs = bounded_batches(docs.filter("text IS NOT NULL"))
    plain = StructType.fromDDL("kind string, text_id binary, n long, places binary, times binary, term binary")
    schema = StructType([*plain.fields, StructField("doc_id", docs.schema["doc_id"].dataType)])
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.mapInArrow(partial(_index, schema=to_arrow_schema(schema), coordinates=coordinates), schema)
    path = new_path(spark, "lexical")
    rows.write.partitionBy("kind").parquet(path)
    held = spark.read.schema(schema).parquet(path)
    of = lambda kind: held.filter(F.col("kind") == kind)
    totals = {bytes(r.term): r.n for r in of("totals").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    vocabulary = of("term").groupBy("term").agg(F.sum("n").alias("df"))
    return LexicalIndex(
        docs.select("text_id", "text"),
        of("text").select("text_id", "n", "places", "times"),
        of("document").select("doc_id", "text_id"),
        staged(vocabulary, "lexical-vocabulary"),
        totals.get(b"documents", 0),
        totals.get(b"terms", 0),
        coordinates,
    )


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = list(counted(text))
            for at in range(0, len(own), 50_000):
                held = own[at : at + 50_000]
                item = batch.column(0).take(pa.array([i] * len(held), pa.int32()))
                yield pa.record_batch([item, pa.array(held, pa.binary())], names=["item", "term"])


@dataclass(frozen=True)
class QueryBlock:
    """Some queries: their terms one query after the other, with weights, and where each query's begin."""

    terms: list[bytes]
    weights: np.ndarray
    starts: np.ndarray
    coordinates: int
    documents: int
    total: int

    def lookups(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct coordinates of the block, and the weight that each query (columns) has at each (rows)."""
        places = _Places(self.coordinates)
        at, slot = np.unique(np.fromiter(map(places.__getitem__, self.terms), np.int64, len(self.terms)), return_inverse=True)
        owner = np.searchsorted(self.starts, np.arange(len(self.terms)), side="right") - 1
        weights = np.zeros((len(at), len(self.starts)), dtype=np.float32)
        np.add.at(weights, (slot, owner), self.weights)
        return at, weights


def bounds(block: QueryBlock, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """For stretches of sketches their text ids and the upper bounds of all queries' scores (columns).

    All of a block's coordinates are looked up at once; a bound is the product of what a sketch has
    there with the queries' weights, rounded up.
    """
    at, weights = block.lookups()
    slots = np.full(block.coordinates, -1, dtype=np.int32)
    slots[at] = np.arange(len(at), dtype=np.int32)
    slack = np.float32(1 + (len(at) + 4) * 2.0**-22)
    rows_at_once = max(1, 4_000_000 // (len(at) + len(block.starts)))
    for batch in batches:
        for first in range(0, len(batch), rows_at_once):
            part = batch.slice(first, rows_at_once)
            held = part.column(2).to_pylist()
            owner = np.repeat(np.arange(len(held)), [len(x) // 4 for x in held])
            slot = slots[np.frombuffer(b"".join(held), "<u4")]
            kept = np.flatnonzero(slot >= 0)
            tf = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8)[kept].astype(np.int64)
            m = length_factor(part.column(1).to_numpy(zero_copy_only=False), block.documents, block.total)
            found = np.zeros((len(held), len(at)), dtype=np.float32)
            found[owner[kept], slot[kept]] = np.where(tf < MOST_TIMES, impact(tf, m[owner[kept]]), LIMIT)
            yield part.column(0).to_pylist(), (found @ weights) * slack


def _emitted(item: np.ndarray, bound: np.ndarray, text_ids: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(item, pa.int32()), pa.array(bound, pa.float32()), pa.array(text_ids, pa.binary())], names=["item", "bound", "text_id"])


def _highest(batches: Iterator[pa.RecordBatch], shared: Broadcast, most: int) -> Iterator[pa.RecordBatch]:
    """The ``most`` texts of highest bound for each query in this task."""
    queries = len(shared.value.starts)
    best, own, ids = np.zeros((0, queries), dtype=np.float32), np.zeros((0, queries), dtype=np.int64), []
    for text_ids, found in bounds(shared.value, batches):
        best = np.concatenate([best, found])
        own = np.concatenate([own, np.repeat(np.arange(len(ids), len(ids) + len(text_ids))[:, None], queries, axis=1)])
        ids += text_ids
        if len(best) > most:
            top = np.argpartition(-best, most - 1, axis=0)[:most]
            best, own = np.take_along_axis(best, top, 0), np.take_along_axis(own, top, 0)
        if len(ids) > 1_000_000:
            kept, flat = np.unique(own, return_inverse=True)
            ids, own = [ids[i] for i in kept.tolist()], flat.reshape(own.shape)
    row, item = np.nonzero(best > 0)
    yield _emitted(item, best[row, item], [ids[i] for i in own[row, item].tolist()])


def _above(batches: Iterator[pa.RecordBatch], shared: Broadcast, bars: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All texts whose bound for a query reaches that query's bar."""
    for text_ids, found in bounds(shared.value, batches):
        row, item = np.nonzero(found >= bars)
        for at in range(0, len(row), 100_000):
            own = slice(at, at + 100_000)
            yield _emitted(item[own], found[row[own], item[own]], [text_ids[i] for i in row[own].tolist()])


def _scores(batches: Iterator[pa.RecordBatch], shared: Broadcast, bars: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Exact scores of texts for the queries listed with each, as far as they reach the query's bar."""
    block, met = shared.value, set()
    ends = np.append(block.starts[1:], len(block.terms)).tolist()
    of_item = [list(zip(block.terms[a:b], block.weights[a:b].tolist(), strict=True)) for a, b in zip(block.starts.tolist(), ends, strict=True)]
    for batch in batches:
        for part in text_slices(batch, 1):
            rows: list[tuple] = []
            for text_id, text, items in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if text_id in met:
                    continue
                met.add(text_id)
                found = counted(text)
                m = length_factor(found.total(), block.documents, block.total)
                part_of = {t: (1_000_000_000 * tf) // (1_000 * tf + 20 * m) for t, tf in found.items()}
                for item in items:
                    score = sum(w * part_of[t] for t, w in of_item[item] if t in part_of)
                    if score >= bars[item]:
                        rows.append((item, text_id, score))
            if rows:
                held = zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64()), strict=True)
                yield pa.record_batch([pa.array(x, k) for x, k in held], names=["item", "text_id", "score"])


def _rescored(found: LexicalIndex, wanted: DataFrame, shared: Broadcast, bars: np.ndarray) -> DataFrame:
    """(item, text_id, score) for pairs of query and text, by one scan of the texts.

    The list of texts travels to all tasks up to 200,000 texts and 2,000,000 pairs; a longer one is
    joined by a shuffle, from which Spark's runtime filter keeps most other texts.
    """
    lists = staged(wanted.groupBy("text_id").agg(F.collect_set("item").alias("items")), "lexical-wanted")
    rows, pairs = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    lists = F.broadcast(lists) if rows <= 200_000 and pairs <= 2_000_000 else lists
    texts = found.docs.join(lists, "text_id").select("text_id", "text", "items")
    scored = texts.mapInArrow(partial(_scores, shared=shared, bars=bars), "item int, text_id binary, score long")
    return staged(scored.distinct(), "lexical-scores")


def _block(rows: list, found: LexicalIndex) -> tuple[list, QueryBlock]:
    """The block's items and what tasks need of them; ``rows`` hold item, term and df."""
    by_item: dict = {}
    for r in rows:
        by_item.setdefault(r.item, []).append((bytes(r.term), r.df))
    weights = {df: math.floor(1000 * math.log((2 * found.documents + 2) / (2 * df + 1))) for df in {r.df for r in rows}}
    held = [own for terms in by_item.values() for own in terms]
    starts = np.cumsum([0, *(len(x) for x in by_item.values())])[:-1]
    flat = np.array([weights[df] for _, df in held], dtype=np.int64)
    return list(by_item), QueryBlock([t for t, _ in held], flat, starts, found.coordinates, found.documents, found.total)


def search(
    found: LexicalIndex, queries: DataFrame, item: str, text: str = "text", depth: int = 50, terms_a_block: int = 8_000, first_wave: int = 4
) -> DataFrame:
    """The ``depth`` documents of highest score above 0 for every query: (``item``, rank, doc_id, score).

    Queries go in blocks of about ``terms_a_block`` terms. For each, a pass over the sketches finds
    the ``first_wave`` * ``depth`` texts of highest bounds; their exact scores give each query a bar,
    the ``depth``-th best of them, and a second pass all texts whose bounds reach it, which are
    scored exactly, too. What is left out is bounded by less than ``depth`` scores, so the result is
    that of scoring everything. Equal texts are scored once and stand for all their documents;
    equal scores go by ascending id, null last. Rows of one item count as one query with the terms
    of all; items without any known term have no row.
    """
    spark = queries.sparkSession
    rank_of, kind = private(queries.select(F.col(quoted(item)).alias(item)), "rank"), queries.schema[item].dataType
    asked = queries.select(F.col(quoted(item)).alias("item"), F.col(quoted(text)).cast("binary").alias("text"))
    schema = StructType([StructField("item", kind), *StructType.fromDDL("term binary").fields])
    asked = asked.mapInArrow(_asked, schema).distinct().join(found.vocabulary, "term")
    asked = staged(asked.select("item", "term", "df"), "lexical-asked")
    blocks = max(1, math.ceil(asked.count() / terms_a_block))
    path, kept = new_path(spark, "lexical-ranked"), StructType([StructField("item", kind), *StructType.fromDDL("text_id binary, score long").fields])
    best = W.partitionBy("item").orderBy(F.desc("bound"), "text_id")
    spark.createDataFrame([], kept).write.parquet(f"{path}/block=-1")
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).collect()
        if not rows:
            continue
        items, block = _block(rows, found)
        shared = spark.sparkContext.broadcast(block)
        pairs = "item int, bound float, text_id binary"
        high = found.sketches.mapInArrow(partial(_highest, shared=shared, most=first_wave * depth), pairs)
        high = high.dropDuplicates(["item", "text_id"]).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= first_wave * depth)
        first = _rescored(found, high, shared, np.ones(len(items), dtype=np.int64))
        # the depth-th score by distinct texts: with copies it can only be higher
        nth = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))
        at_depth = first.withColumn("nth", nth).filter(F.col("nth") <= depth).groupBy("item").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n"))
        bars = np.ones(len(items), dtype=np.int64)
        for r in at_depth.filter(F.col("n") == depth).collect():
            bars[r.item] = r.bar
        left = found.sketches.mapInArrow(partial(_above, shared=shared, bars=bars), pairs).join(first, ["item", "text_id"], "left_anti")
        scored = first.unionByName(_rescored(found, left, shared, bars)).join(F.broadcast(spark.createDataFrame([(i, b) for i, b in enumerate(bars.tolist())], "item int, bar long")), "item")
        named = spark.createDataFrame([(i, x) for i, x in enumerate(items)], StructType([*StructType.fromDDL("number int").fields, StructField("item", kind)]))
        scored = scored.filter("score >= bar").select(F.col("item").alias("number"), "text_id", "score").join(F.broadcast(named), "number")
        scored.select("item", "text_id", "score").write.parquet(f"{path}/block={number}")
        shared.unpersist()
    ranked = spark.read.schema(kept).parquet(path).select("item", "text_id", "score")
    texts = staged(ranked.select("text_id").distinct(), "lexical-texts")
    own = W.partitionBy("text_id").orderBy(F.asc_nulls_last("doc_id"))
    members = found.members.join(sized(texts), "text_id").withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= depth).drop("nth")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = ranked.join(members, "text_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)
    return out.select(F.col("item").alias(item), F.col("rank").alias(rank_of), "doc_id", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each item of ``benchmark``."""
    found = index(table(spark, sf_dir, "documents"))
    return search(found, table(spark, sf_dir, "benchmark"), "item_id")


OP11_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL
), docs AS (
    SELECT row_id, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0
), totals AS (
    SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs
), wanted AS (
    SELECT DISTINCT item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL
), held AS (
    SELECT row_id, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
    FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM wanted)
    GROUP BY row_id, doc_id, n, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM held, totals GROUP BY term, big_n
), scored AS (
    SELECT item_id, row_id, doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
    FROM wanted JOIN held USING (term) JOIN weights USING (term), totals
    GROUP BY item_id, row_id, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""
