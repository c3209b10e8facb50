"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, sized, staged, table
from marlstone.llm.components import connected_components
from marlstone.llm.tokens import text_slices

#: Values of b bits in a chunk of the signature, of which one may differ.
CHUNK = 4
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words; starts anew when it has grown to ``most`` words."""

    most = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without words.

    A-Z count as lower case, and white space is what bytes.split() takes for it: blank and 9 to 13.
    Fewer than ``words`` words make one shingle of them all.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    span = min(words, len(parts))
    count = len(parts) - span + 1
    out = np.full(count, span, dtype=np.uint64)
    for i in range(span):
        out = (out ^ hashes[i : i + count]) * _MULTIPLIER
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signatures(sets: list[np.ndarray], values: int) -> np.ndarray:
    """Min-hash signatures, one row of ``values`` 16-bit values for each non-empty set."""
    random = np.random.default_rng(20_24)
    factors = random.integers(1, 1 << 63, values, dtype=np.uint64) | np.uint64(1)
    addends = random.integers(0, 1 << 63, values, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), values), dtype="<u2")
    for k in range(values):
        mixed = flat * factors[k] + addends[k]
        mixed ^= mixed >> np.uint64(33)
        out[:, k] = (np.minimum.reduceat(mixed, starts) >> np.uint64(8)).astype(np.uint16)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, values: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, 2):
            sets = [shingles(text, words) for text in part.column(2).to_pylist()]
            filled = [s for s in sets if len(s)]
            signed = iter(signatures(filled, values)) if filled else iter(())
            rows = [
                (len(s), xxhash.xxh3_128_digest(s.tobytes()), next(signed).tobytes()) if len(s) else (0, None, None)
                for s in sets
            ]
            kinds = (pa.int64(), pa.binary(), pa.binary())
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["doc_id", "text_hash", "n_shingles", "set_id", "signature"]
            yield pa.record_batch([part.column(0), part.column(1), *columns], names=names)
    _HASHES.clear()


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    met: set[int] = set()  # a row may be repeated any number of times
    for batch in batches:
        for part in text_slices(batch, 1):
            nodes = part.column(0).to_pylist()
            fresh = [i for i, node in enumerate(nodes) if not (node in met or met.add(node))]
            part = part.take(pa.array(fresh, pa.int64()))
            sets = pa.array([shingles(text, words).tobytes() for text in part.column(1).to_pylist()], pa.binary())
            yield pa.record_batch([part.column(0), part.column(2), sets], names=["node", "places", "content"])
    _HASHES.clear()


def linked(sets: list[np.ndarray], percent: int, width: int = 4096) -> np.ndarray:
    """Which sets are alike: 100 * intersection >= ``percent`` * union, as a matrix of booleans."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owners = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # the others are in no intersection
    owners, column = owners[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    order = np.argsort(column, kind="stable")
    owners, column = owners[order], column[order]
    common = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owners[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    np.fill_diagonal(common, sizes)
    common = common.astype(np.int64)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def _roots(alike: np.ndarray) -> np.ndarray:
    """For each row the first row that it is connected to."""
    root = np.full(len(alike), -1)
    for i in range(len(alike)):
        if root[i] < 0:
            reached = np.zeros(len(alike), dtype=bool)
            edge = np.zeros(len(alike), dtype=bool)
            edge[i] = True
            while edge.any():
                reached |= edge
                edge = alike[edge].any(axis=0) & ~reached
            root[reached] = i
    return root


def _star(nodes: list[int], alike: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph ``alike``: each node with the first that it is connected to."""
    return [(nodes[i], nodes[r]) for i, r in enumerate(_roots(alike)) if i != r]


def _confirmed(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links by full sets within each group of the rows, as a star around the smallest node of every class."""
    out: list[tuple[int, int]] = []
    for _, own in rows.drop_duplicates(["group", "node"]).sort_values("node").groupby("group", sort=False):
        sets = [np.frombuffer(c, dtype=np.uint64) for c in own["content"]]
        out += _star(own["node"].tolist(), linked(sets, percent))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def signature_distances(signed: np.ndarray, width: int = 256) -> np.ndarray:
    """Hamming distances of all pairs of rows: how many of their values differ."""
    out = np.empty((len(signed), len(signed)), dtype=np.uint8 if signed.shape[1] < 256 else np.uint16)
    for at in range(0, len(signed), width):
        part = out[at : at + width]
        part[:] = 0
        for k in range(signed.shape[1]):
            part += signed[at : at + width, k, None] != signed[None, :, k]
    return out


def _signed(rows: pd.DataFrame, percent: int, below: int) -> pd.DataFrame:
    """Candidates within each group: signatures that differ in fewer than ``below`` values, apart so far."""
    out: list[tuple[int, int]] = []
    for _, own in rows.drop_duplicates(["group", "node"]).sort_values("node").groupby("group", sort=False):
        if own["comp"].nunique() < 2:
            continue
        signed = np.frombuffer(b"".join(own["signature"]), dtype="<u2").reshape(len(own), -1)
        comp, sizes = own["comp"].to_numpy(), own["n_shingles"].to_numpy()
        fits = 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
        near = (signature_distances(signed) < below) & fits & (comp[:, None] != comp[None, :])
        np.fill_diagonal(near, True)
        out += _star(own["node"].tolist(), near)
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _index_keys(chunks: int) -> Column:
    """For each chunk of the signature and each place in it that may differ, a key of the others."""
    keys = []
    for chunk in range(chunks):
        first = 2 * CHUNK * chunk
        for skip in range(CHUNK):
            before = F.substring("signature", first + 1, 2 * skip)
            after = F.substring("signature", first + 2 * skip + 3, 2 * (CHUNK - skip - 1))
            keys.append(F.xxhash64(F.lit(chunk * CHUNK + skip), before, after))
    return F.array(*keys)


def _distance(a: str, b: str, values: int) -> Column:
    """Hamming distance of two signatures as a column."""
    at = lambda c, k: F.substring(c, 2 * k + 1, 2)
    return sum((F.when(at(a, k) == at(b, k), 0).otherwise(1) for k in range(1, values)), F.when(at(a, 0) == at(b, 0), 0).otherwise(1))


def chunks_for(percent: int, miss: float = 1e-5) -> int:
    """Chunks of the signature so that a pair at the threshold differs in 2 values a chunk, or more, less often than ``miss``."""
    same, chunks = percent / 100, 1
    while chunks < 60:
        n = CHUNK * chunks
        beyond = sum(math.comb(n, k) * (1 - same) ** k * same ** (n - k) for k in range(2 * chunks, n + 1))
        if beyond < miss:
            break
        chunks += 1
    return chunks


def _facing(members: DataFrame, most_docs: int, most_shingles: int) -> DataFrame:
    """Cells in which all pairs of a group meet that are of different components.

    ``members`` has (group, node, comp, n_shingles, ...). A group of up to ``most_docs`` and
    ``most_shingles`` is one cell. In a larger one, the members outside its largest component make
    blocks, all members make blocks, and each of the former meets each of the latter: what the
    largest component has inside is connected already. Adds ``low`` and ``high``, -1 in small groups.
    """
    counts = members.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    largest = F.max_by(F.struct("comp", "n", "w"), F.struct("n", "comp"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), largest.alias("most"))
    blocks = lambda n, w: F.ceil(F.greatest(n / most_docs * 2, w / most_shingles * 2, F.lit(1))).cast("int")
    large = staged(
        totals.filter((F.col("n") > most_docs) | (F.col("w") > most_shingles)).select(
            "group",
            F.col("most.comp").alias("main"),
            blocks(F.col("n"), F.col("w")).alias("highs"),
            blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("lows"),
        ),
        "near-large",
    )
    joined = members.join(sized(large), "group", "left")
    own_low = F.pmod(F.xxhash64("node", F.lit("low")), F.col("lows")).cast("int")
    own_high = F.pmod(F.xxhash64("node"), F.col("highs")).cast("int")
    pair = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    as_any = F.transform(F.sequence(F.lit(0), F.col("lows") - 1), lambda low: pair(low, own_high))
    as_other = F.transform(F.sequence(F.lit(0), F.col("highs") - 1), lambda high: pair(own_low, high))
    cells = (
        F.when(F.col("main").isNull(), F.array(pair(F.lit(-1), F.lit(-1))))
        .when(F.col("comp") == F.col("main"), as_any)
        .otherwise(F.array_distinct(F.concat(as_any, as_other)))
    )
    return joined.select(*members.columns, F.explode(cells).alias("_at")).select(*members.columns, "_at.low", "_at.high")


def _dealt(rows: DataFrame, spread: int) -> DataFrame:
    """Adds ``cell``: the group of rows in a cell of their own, else one of ``spread`` cells that small groups share."""
    shared = F.pmod(F.xxhash64("group"), F.lit(spread))
    return rows.withColumn("cell", F.when(F.col("low") >= 0, F.col("group")).otherwise(shared))


def _confirmed_links(read: DataFrame, classes: DataFrame, placed: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between sets that meet in a cell of ``placed`` (node, group, low, high), a spanning forest for each cell."""
    total = placed.join(classes.select("node", "n_shingles"), "node").agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
    size, weight = total[0], total[1] or 0
    wanted = (
        placed.groupBy("node")
        .agg(F.collect_list(F.struct("group", "low", "high")).alias("places"))
        .join(classes.select("node", "doc_id", "text_hash"), "node")
        .select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "node", "places")
    )
    # up to this many the places travel to the texts; beyond, texts are shuffled by doc_id
    wanted = F.broadcast(wanted) if size <= 500_000 else wanted
    sets = (
        read.filter("text IS NOT NULL AND doc_id IS NOT NULL")
        .join(wanted, (F.col("doc_id") == F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
        .select("node", "text", "places")
        .mapInArrow(
            partial(_sets, words=words), "node long, places array<struct<group: bigint, low: int, high: int>>, content binary"
        )
        .filter(F.octet_length("content") > 0)
        .select("node", "content", F.inline("places"))
    )

    def confirm(rows: pd.DataFrame) -> pd.DataFrame:
        return _confirmed(rows, percent)

    spread = 1 + max(size // 256, weight // 500_000)
    return staged(_dealt(sets, spread).groupBy("cell", "low", "high").applyInPandas(confirm, "a long, b long"), "near-links")


def _stars(shared: DataFrame, classes: DataFrame, chunks: int, percent: int, cell_docs: int, cell_shingles: int) -> DataFrame:
    """Places of candidates beside the first node that has a key of theirs: (node, group, low, high)."""
    signed = lambda end: classes.select(
        F.col("node").alias(end), F.col("signature").alias(f"{end}_signature"), F.col("n_shingles").alias(f"{end}_size")
    )
    fits = 100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")
    near = staged(
        shared.filter("node != first")
        .select(F.col("node").alias("a"), F.col("first").alias("b"))
        .distinct()
        .join(signed("a"), "a")
        .join(signed("b"), "b")
        .filter(fits & (_distance("a_signature", "b_signature", CHUNK * chunks) < 2 * chunks))
        .select("a", "b", "a_size"),
        "near-stars",
    )
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / cell_docs, F.sum("a_size") / cell_shingles)).cast("int")
    sizes = near.groupBy("b").agg(parts.alias("parts"))
    large = staged(sizes.filter("parts > 1"), "near-hubs")
    arms = near.join(sized(large), "b", "left").select(
        F.col("a").alias("node"),
        F.col("b").alias("group"),
        F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("a"), F.col("parts"))).cast("int").alias("low"),
    )
    first = F.when(F.col("parts") == 1, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    centers = sizes.select(F.col("b").alias("node"), F.col("b").alias("group"), F.explode(first).alias("low"))
    return staged(arms.unionByName(centers).withColumn("high", F.col("low")), "near-places")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    cell_docs: int = 1024,
    cell_shingles: int = 2_000_000,
) -> DataFrame:
    """Near-duplicate classes of documents by the Jaccard similarity of their word shingles.

    Documents are linked where 100 * intersection >= ``percent`` * union of their full sets.

    Signatures of 16-bit min-hash values are cut into chunks of CHUNK. Candidates are the pairs whose
    signatures differ in fewer than 2 * chunks values; by the pigeonhole principle such a pair has a
    chunk with at most one error, so each chunk is indexed once for each place that may differ, and
    none is missed. The number of chunks follows from ``percent``: a pair at that similarity is no
    candidate in fewer than 1e-5 of cases. Documents of equal sets count as one from here on.

    First, every holder of a key meets the key's first holder: candidates by signature distance are
    confirmed on their full sets. That connects groups of copies, of any size, by one comparison a
    document and key. What shares a key but is not connected then meets in cells by signature; what
    proves a candidate there meets in cells by full sets, all pairs of different components. Cells
    hold at most about ``cell_docs`` documents or ``cell_shingles`` shingles and report a spanning
    forest, so no step makes rows by the pair.

    Returns one row per input row: doc_id, n_shingles (set size), component_id (smallest doc_id
    reachable by links), kept (doc_id = component_id), text_hash (xxhash64 of the text) and chosen:
    whether (doc_id, text_hash) is the smallest of the class, which is true of one document of each
    even where ids are repeated. Null, empty and blank texts have empty sets and are linked with
    nothing. Repeated rows share a class, and each is returned; rows of one id and different texts
    are different documents. Rows without doc_id take no part: their component is null, and they are
    kept and chosen. Texts are read whole, however long. Columns other than doc_id and text play no
    part, whatever their names. An empty table gives no rows.
    """
    chunks = chunks_for(percent)
    read = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    prints = staged(
        read.mapInArrow(
            partial(_fingerprints, words=words, values=CHUNK * chunks),
            "doc_id long, text_hash long, n_shingles long, set_id binary, signature binary",
        ),
        "near-fingerprints",
    )
    # numbered when written, so nodes stay what they are
    classes = staged(
        prints.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set_id")
        .agg(
            F.min(F.struct("doc_id", "text_hash")).alias("one"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select(F.monotonically_increasing_id().alias("node"), "set_id", "one.*", "n_shingles", "signature", "copies"),
        "near-classes",
    )
    postings = classes.select("node", F.explode(_index_keys(chunks)).alias("key"))
    keyed = postings.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = staged(postings.join(keyed, "key"), "near-shared")
    stars = _stars(shared, classes, chunks, percent, cell_docs, cell_shingles)
    component = connected_components(_confirmed_links(read, classes, stars, words, percent))

    # keys whose holders are not all connected yet; each has met the first holder, so that one needs no more
    held = shared.filter("node != first").select(F.col("key").alias("group"), "node").join(component, "node", "left")
    held = held.select("group", "node", F.coalesce("component", "node").alias("comp"))
    apart = held.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("group")
    left = staged(held.join(apart, "group").join(classes.select("node", "signature", "n_shingles"), "node"), "near-left")
    rest = left.count()
    if rest:

        def sign(rows: pd.DataFrame) -> pd.DataFrame:
            return _signed(rows, percent, 2 * chunks)

        met = _dealt(_facing(left, 4 * cell_docs, 1 << 62), 1 + rest // 1024)
        groups = connected_components(met.groupBy("cell", "low", "high").applyInPandas(sign, "a long, b long"))
        members = (
            groups.select("node", F.col("component").alias("group"))
            .join(component, "node", "left")
            .join(classes.select("node", "n_shingles"), "node")
            .select("group", "node", F.coalesce("component", "node").alias("comp"), "n_shingles")
        )
        placed = staged(_facing(staged(members, "near-members"), cell_docs, cell_shingles).select("node", "group", "low", "high"), "near-places")
        more = _confirmed_links(read, classes, placed, words, percent)
        component = connected_components(more.unionByName(component.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    told = classes.select("node", "set_id", "doc_id", "text_hash", "copies").join(component, "node", "left")
    single = told.filter("component IS NULL AND copies > 1").select("set_id", F.struct("doc_id", "text_hash").alias("least"))
    smallest = told.filter("component IS NOT NULL").groupBy("component").agg(least)
    linked_sets = told.filter("component IS NOT NULL").select("set_id", "component").join(smallest, "component").select("set_id", "least")
    own = F.col("doc_id").isNotNull()
    least_id = F.coalesce("least.doc_id", "doc_id")
    return prints.join(single.unionByName(linked_sets), "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(own, least_id).alias("component_id"),
        F.when(own, F.col("doc_id") == least_id).otherwise(F.lit(True)).alias("kept"),
        "text_hash",
        F.when(own & F.col("least").isNotNull(), (F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash")))
        .otherwise(F.lit(True))
        .alias("chosen"),
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents`` by shingles of three words, from 85 %."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, and the components of the links among them.
OP4_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
                      FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL) p
    JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
    WHERE 100 * common >= 85 * (m.n + n.n - common)
), edges AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
    SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), lowest AS (
    SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id,
       d.doc_id = coalesce(l.component, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN lowest l ON l.a = d.doc_id
"""
