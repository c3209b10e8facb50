"""Embedding near-dedup: a forest of random-projection trees with overlapping splits."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import sized, staged, table
from marlstone.llm.components import connected_components


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1; scaled first, so that no square overflows."""
    rows = vectors.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _unpacked(raw: pd.Series, kind: str) -> np.ndarray:
    """Unit rows of vectors that travel as bytes of the type they are read in."""
    return unit_rows(np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1))


#: Directions that a node tries, and the quantiles along each at which it may be split.
DIRECTIONS, QUANTILES = 4, (0.5, 0.375, 0.625, 0.25, 0.75, 0.125, 0.875)
#: A node may put this share of its rows on both sides, and this share on its larger side.
MOST_OVERLAP, MOST_SIDE = 1 / 3, 0.9


@dataclass
class Forest:
    """Trees of splits; a row near a split goes to both sides, so it may reach several leaves.

    A split must not let the sum of rows ** 1.5 over its sides grow, and no side may fall below a
    quarter of the size at which splitting ends. So over a whole tree a row reaches at most
    2 * sqrt(rows / that size) leaves on average, however dense the rows lie. A node that has no
    such split is a leaf; its rows are compared in blocks.
    """

    dimension: int
    leaves: int = 0
    roots: list = field(default_factory=list)
    stuck: list = field(default_factory=list)  # leaves that no split would lighten, however many rows they have

    def grow(self, sample: np.ndarray, trees: int, rows: int, leaf_rows: int, margin: float, seed: int) -> Forest:
        """Fit splits to a ``sample`` of ``rows`` rows until leaves should hold ``leaf_rows``.

        Rows within ``margin`` of a split go to both sides.
        """
        random = np.random.default_rng(seed)
        least = max(16.0, leaf_rows * len(sample) / max(rows, 1))
        self.roots = [self._split(sample, np.arange(len(sample)), least, margin, random) for _ in range(trees)]
        return self

    def _split(self, sample: np.ndarray, own: np.ndarray, least: float, margin: float, random) -> tuple | int:
        if len(own) > least:
            directions = random.standard_normal((DIRECTIONS, self.dimension))
            directions /= np.linalg.norm(directions, axis=1, keepdims=True)
            best = None
            for direction, along in zip(directions, directions @ sample[own].T, strict=True):
                ordered = np.sort(along)
                for middle in np.quantile(ordered, QUANTILES).tolist():
                    left = int(np.searchsorted(ordered, middle + margin, side="right"))
                    right = len(own) - int(np.searchsorted(ordered, middle - margin, side="left"))
                    growth = (left**1.5 + right**1.5) / len(own) ** 1.5
                    fits = growth <= 1 and left + right <= (1 + MOST_OVERLAP) * len(own)
                    if fits and min(left, right) >= least / 4 and max(left, right) < MOST_SIDE * len(own):
                        if best is None or growth < best[0]:
                            best = growth, direction, middle, along
            if best is not None:
                _, direction, middle, along = best
                parts = along <= middle + margin, along >= middle - margin
                sides = [self._split(sample, own[side], least, margin, random) for side in parts]
                return direction, middle, margin, *sides
            self.stuck.append(self.leaves)
        self.leaves += 1
        return self.leaves - 1

    def route(self, rows: np.ndarray) -> list[list[int]]:
        """Leaves of each row, ascending."""
        out: list[list[int]] = [[] for _ in range(len(rows))]
        for root in self.roots:
            pending = [(root, np.arange(len(rows)))]
            while pending:
                node, own = pending.pop()
                if isinstance(node, int):
                    for i in own.tolist():
                        out[i].append(node)
                    continue
                direction, middle, margin, left, right = node
                along = rows[own] @ direction
                pending.append((left, own[along <= middle + margin]))
                pending.append((right, own[along >= middle - margin]))
        return [sorted(x) for x in out]


#: Rows of an over-full leaf that its own splits are fitted to, rows of it that one task sends down them,
#: and how often leaves are split again: each time they may hold some hundred times fewer rows.
SPLIT_SAMPLE, SPLIT_BLOCK, SPLIT_TURNS = 2_000, 8_192, 2


def _split_again(
    routed: DataFrame, turn: int, stuck: list[int], most: int, leaf_rows: int, margin: float, seed: int, kind: str
) -> tuple[DataFrame, bool]:
    """``routed`` (node, copies, raw, leaves) with leaves of more than ``most`` rows split by trees of their own.

    The forest is fitted to a sample of bounded size, so its leaves grow with the rows. Each over-full
    one gets a tree, fitted to a sample of its own rows in a task; the trees never reach the driver,
    but meet their leaf's rows, block by block. Leaves that no split would lighten stay as they are.
    """
    sizes = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    tag = (turn - 1) << 58
    fresh = (F.col("leaf") >= tag) & (~F.col("leaf").isin(stuck) if turn == 1 and stuck else F.lit(True))
    over = staged(sizes.filter((F.col("n") > most) & fresh), "vector-over")
    if over.isEmpty():
        return routed, False
    own = routed.select("node", "raw", F.explode("leaves").alias("leaf")).join(sized(over), "leaf")

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        unit = _unpacked(rows["raw"], kind)
        forest = Forest(unit.shape[1]).grow(unit, 1, int(rows["n"].iloc[0]), leaf_rows, margin / math.sqrt(unit.shape[1]), seed + turn)
        return pd.DataFrame({"leaf": [key[0]], "tree": [pickle.dumps(forest)], "parts": [forest.leaves]})

    point = F.pmod(F.xxhash64("node", F.lit(seed + turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = own.filter(point * F.col("n") < SPLIT_SAMPLE).groupBy("leaf")
    trees = staged(some.applyInPandas(grow, "leaf long, tree binary, parts int").filter("parts > 1"), "vector-trees")
    blocks = F.ceil(F.col("n") / SPLIT_BLOCK).cast("int")
    split = staged(over.join(trees.select("leaf"), "leaf").select("leaf", blocks.alias("blocks")), "vector-split")
    if split.isEmpty():
        return routed, False
    dealt = own.drop("n").join(sized(split), "leaf").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    copied = trees.join(split, "leaf").select(F.col("leaf").alias("of_leaf"), "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("of_block"))

    def descend(key: tuple, rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"node": [], "gone": [], "subs": []}).astype({"node": "int64", "gone": "int64"})
        unit = _unpacked(rows["raw"], kind)
        # a new id holds its parent's, and the turn above it
        base = (turn << 58) | ((int(key[0]) & ((1 << 58) - 1)) << 12)
        subs = [[base | x for x in found] for found in pickle.loads(tree["tree"].iloc[0]).route(unit)]
        return pd.DataFrame({"node": rows["node"], "gone": int(key[0]), "subs": subs})

    moved = (
        dealt.select("leaf", "block", "node", "raw")
        .groupBy("leaf", "block")
        .cogroup(copied.groupBy("of_leaf", "of_block"))
        .applyInPandas(descend, "node long, gone long, subs array<long>")
        .groupBy("node")
        .agg(F.collect_list("gone").alias("gone"), F.flatten(F.collect_list("subs")).alias("subs"))
    )
    none = F.expr("cast(array() AS array<bigint>)")
    leaves = F.array_sort(F.concat(F.array_except("leaves", F.coalesce("gone", none)), F.coalesce("subs", none)))
    return staged(routed.join(moved, "node", "left").select("node", "copies", "raw", leaves.alias("leaves")), "vector-leaves"), True


def _compare(rows: pd.DataFrame, low: int, high: int, least: float, kind: str) -> pd.DataFrame:
    """Links between the rows of a cell that no leaf of their ``earlier`` ones has: weight of links and root by node."""
    rows = rows.sort_values("node")
    nodes, copies, block = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["block"].to_numpy()
    unit = _unpacked(rows["raw"], kind)
    first = np.flatnonzero(block == low)
    second = first if low == high else np.flatnonzero(block == high)
    pairs = []
    for at in range(0, len(first), 1024):
        own = first[at : at + 1024]
        i, j = np.nonzero(unit[own] @ unit[second].T >= least)
        i, j = own[i], second[j]
        kept = i < j if low == high else np.ones(len(i), dtype=bool)
        pairs.append((i[kept], j[kept]))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (first[:0], first[:0])
    met = np.unique(np.concatenate([i, j]))
    links, root = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
    if len(met):
        earlier = [np.asarray(x).tolist() for x in rows["earlier"].iloc[met]]
        number = {x: n for n, x in enumerate(sorted({x for own in earlier for x in own}))}
        shared = np.zeros((len(met), max(1, len(number))), dtype=np.float32)
        for n, own in enumerate(earlier):
            shared[n, [number[x] for x in own]] = 1
        place = np.searchsorted(met, i), np.searchsorted(met, j)
        new = np.ones(len(i), dtype=bool)
        for at in range(0, len(i), 100_000):
            part = slice(at, at + 100_000)
            new[part] = ~np.logical_and(shared[place[0][part]], shared[place[1][part]]).any(axis=1)
        i, j = i[new], j[new]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for start, others in zip(starts.tolist(), np.split(j, starts[1:]), strict=True) if len(i) else ():
            _join(root, int(i[start]), others)
    top = np.array([_find(root, n) for n in range(len(rows))], dtype=np.int64)
    found = np.flatnonzero((links > 0) | (top != np.arange(len(rows))))
    return pd.DataFrame({"node": nodes[found], "links": links[found], "root": nodes[top[found]]})


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _join(root: np.ndarray, i: int, others: np.ndarray) -> None:
    tops = {_find(root, int(j)) for j in np.unique(root[others])} | {_find(root, int(i))}
    least = min(tops)
    for t in tops:
        root[t] = least


def near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.9,
    trees: int = 3,
    leaf_rows: int = 512,
    spill: float = 0.5,
    sample_rows: int = 20_000,
    cell_rows: int = 2048,
    seed: int = 7,
) -> DataFrame:
    """Links between vectors of cosine ``least`` or more, found in the leaves of a forest.

    Equal vectors count as one from the start. The forest is fitted to at most about
    ``sample_rows`` of the others, chosen by hash, and so small enough to send to all tasks; then
    every vector goes down every tree, and to both sides of a split where it is nearer to it than
    ``spill`` times the distance of rows at the threshold along the direction. Where rows lie so dense
    that splits would mostly put them on both sides, splitting ends (see :class:`Forest`). Leaves that hold
    too many rows because the sample ran out are split again by trees of their own. Within a leaf all pairs are
    compared by cosine in double precision; leaves of more than ``cell_rows`` are cut into blocks,
    whose pairs are cells of their own, so no task grows with a dense region. A pair counts in the
    first leaf that both share, so links are counted without making a row for each; every cell
    also gives a spanning forest of its links, and the components of all are united.

    Returns one row per input row: id, n_links (other vectors linked directly), component_id
    (smallest id reachable by links), kept (id = component_id). Vectors that are null, empty, zero
    or hold null or non-finite components are linked with nothing, nor are rows without id; vectors
    are compared with those of their own dimension. Repeated rows are vectors of their own; columns of
    other names play no part. An empty table gives no rows.
    """
    spark = rows.sparkSession
    vector = F.col("vector")
    read = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    keyed = read.withColumns({"k1": F.xxhash64(F.lit(1), vector), "k2": F.xxhash64(F.lit(2), vector)})
    classes = staged(
        keyed.filter(F.col("vec_id").isNotNull() & usable(vector))
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")),
        "vector-classes",
    )
    total = classes.count()
    kind = "<f4" if dict(read.dtypes)["vector"] == "array<float>" else "<f8"
    share = min(1.0, sample_rows / max(total, 1))
    point = F.pmod(F.xxhash64("k1", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    forests, first_leaf = {}, 0
    sample = classes.filter(point < share).select("vector").toPandas()["vector"]
    for dimension, own in sample.groupby(sample.map(len)):
        size = int(total * len(own) / max(len(sample), 1))
        # along a random direction, rows at the threshold are so far apart (standard deviation)
        apart = math.sqrt(max(2 - 2 * least, 0.0) / dimension)
        unit = unit_rows(np.stack(own.to_list()))
        forest = Forest(int(dimension)).grow(unit, trees, size, leaf_rows, spill * apart, seed)
        forests[int(dimension)] = (first_leaf, forest)
        first_leaf += forest.leaves
    shared = spark.sparkContext.broadcast(forests)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            raw: list = [None] * len(batch)
            leaves: list = [None] * len(batch)
            for dimension in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dimension)
                rows = flat[starts[own][:, None] + np.arange(dimension)].astype(kind)
                # a dimension that is not in the sample has one leaf
                base, forest = forests_of().get(dimension, (-dimension, None))
                routes = forest.route(unit_rows(rows)) if forest else [[0]] * len(own)
                for i, row, found in zip(own.tolist(), rows, routes, strict=True):
                    raw[i] = row.tobytes()
                    leaves[i] = (base + np.array(found)).astype("<i8")
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(raw, pa.binary()),
                    pa.array(leaves, pa.list_(pa.int64())),
                ],
                names=["node", "copies", "raw", "leaves"],
            )

    def forests_of() -> dict:
        return shared.value

    routed = staged(
        classes.select("node", "vector", "copies").mapInArrow(
            route, "node long, copies long, raw binary, leaves array<long>"
        ),
        "vector-leaves",
    )
    stuck = [first + leaf for first, forest in forests.values() for leaf in forest.stuck]
    apart = math.sqrt(max(2 - 2 * least, 0.0))
    for turn in range(1, SPLIT_TURNS + 1):
        routed, more = _split_again(routed, turn, stuck, max(cell_rows, 4 * leaf_rows), leaf_rows, spill * apart, seed, kind)
        if not more:
            break
    placed = routed.withColumn("leaf", F.explode("leaves"))
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.select("leaf", F.when(F.col("n") <= cell_rows, 1).otherwise(F.ceil(F.col("n") / (cell_rows // 2))).cast("int").alias("blocks"))
    # a cell needs the leaves before its own only
    cells = (
        placed.withColumn("earlier", F.filter("leaves", lambda x: x < F.col("leaf")))
        .join(blocks, "leaf")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "copies", "raw", "earlier", "block")
    )

    def compare(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return _compare(own, int(key[1]), int(key[2]), least, kind)

    found = staged(cells.groupBy("leaf", "low", "high").applyInPandas(compare, "node long, links long, root long"), "vector-links")
    linked = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    special = (
        classes.select("k1", "k2", "node", "copies")
        .join(counts, "node", "left")
        .join(linked, "node", "left")
        .filter("copies > 1 OR links IS NOT NULL")
        .select(
            "k1",
            "k2",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    component = F.coalesce("component", "vec_id")
    return (
        keyed.withColumn("usable", F.col("vec_id").isNotNull() & usable(vector))
        .select("vec_id", F.when(F.col("usable"), F.col("k1")).alias("k1"), F.when(F.col("usable"), F.col("k2")).alias("k2"))
        .join(special, ["k1", "k2"], "left")
        .select(
            F.col("vec_id").alias(id_col),
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        )
    )


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all ``embeddings`` at a cosine of 0.9 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All cosines, and the components of the links among them.
OP9_SQL = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), edges AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.9
), reach(a, b) AS (
    SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), lowest AS (
    SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a
)
SELECT d.vec_id, (SELECT count(*) FROM edges e WHERE e.a = d.vec_id) AS n_links, coalesce(l.component, d.vec_id) AS component_id,
       d.vec_id = coalesce(l.component, d.vec_id) AS kept
FROM embeddings d LEFT JOIN lowest l ON l.a = d.vec_id
"""
