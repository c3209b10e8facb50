"""Exact top-k search: best-first search in M-trees of paged metric nodes, dealt by pivots."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import sized, staged, table

PAGES = (
    "dimension int, cell int, part int, page int, parent int, center binary, radius double, to_parent double,"
    " rows binary, ids binary, to_center binary"
)
#: Below this, sums of products of whole numbers are exact in doubles, and in longs.
EXACT_DOUBLE, EXACT_LONG = 2.0**53, 2.0**63


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(``scale`` * x) of every component x, taken as double; null without any, or if one is null or not finite.

    A component whose value is beyond a long is an error, never another number.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    beyond = F.raise_error(F.lit("a component of a vector, times the scale, is beyond 64 bits")).cast("long")

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when((scaled >= -EXACT_LONG) & (scaled < EXACT_LONG), F.floor(scaled).cast("long")).otherwise(beyond)

    return F.when(
        F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False)),
        F.transform(vector, whole),
    )


def lifted(rows: np.ndarray, reach: float) -> np.ndarray:
    """Vectors with one more component that gives all of them the squared length ``reach``.

    Their Euclidean distance to a query with a zero there falls as the inner product grows.
    """
    rest = np.sqrt(np.maximum(reach - np.einsum("ij,ij->i", rows, rows), 0.0))
    return np.column_stack([rows, rest])


class MTree:
    """Pages of one tree: inner ones route to pages, leaves hold rows; all know the way to their center."""

    def __init__(self, page_rows: int, fanout: int, seed: int):
        self.page_rows, self.fanout = page_rows, fanout
        self.random = np.random.default_rng(seed)
        self.pages: list[tuple] = []  # parent, center, radius, distance to parent's center, own rows, their distances

    def build(self, points: np.ndarray) -> MTree:
        everything = np.arange(len(points))
        self._add(points, everything, int(everything[0]), -1, None)
        return self

    def _add(self, points: np.ndarray, own: np.ndarray, center: int, parent: int, above: int | None) -> None:
        distance = np.linalg.norm(points[own] - points[center], axis=1)
        upward = 0.0 if above is None else float(np.linalg.norm(points[center] - points[above]))
        leaf = len(own) <= self.page_rows
        page = len(self.pages)
        self.pages.append((parent, center, float(distance.max()), upward, own if leaf else own[:0], distance if leaf else distance[:0]))
        if leaf:
            return
        pivots = self.random.choice(own, min(self.fanout, -(-2 * len(own) // self.page_rows)), replace=False)
        nearest = np.argmin(
            [np.linalg.norm(points[own] - points[p], axis=1) for p in pivots.tolist()], axis=0
        )
        parts = [(int(p), own[nearest == i]) for i, p in enumerate(pivots.tolist())]
        if max(len(x) for _, x in parts) == len(own):  # no pivot tells the rows apart
            parts = [(int(x[0]), x) for x in np.array_split(own, len(pivots))]
        for pivot, rows in parts:
            if len(rows):
                self._add(points, rows, pivot, page, center)


def _build(rows: pd.DataFrame, reach: float, page_rows: int, fanout: int) -> pd.DataFrame:
    rows = rows.sort_values("first")
    vectors = np.stack(rows["vector"].to_list()).astype("<i8")
    points = lifted(vectors.astype(np.float64), reach)
    tree = MTree(page_rows, fanout, len(rows)).build(points)
    ids = rows["ids"].to_list()
    width = max(map(len, ids))
    padded = np.array([np.pad(x, (0, width - len(x)), constant_values=-1) for x in ids], dtype="<i8")
    known = np.array([len(x) for x in ids], dtype="<i8")
    out = [
        (
            parent,
            points[center].tobytes(),
            radius,
            upward,
            vectors[own].tobytes(),
            np.column_stack([known[own], padded[own]]).tobytes(),
            distance.tobytes(),
        )
        for parent, center, radius, upward, own, distance in tree.pages
    ]
    frame = pd.DataFrame(out, columns=["parent", "center", "radius", "to_parent", "rows", "ids", "to_center"])
    frame.insert(0, "page", np.arange(len(out)))
    for name in ("part", "cell", "dimension"):
        frame.insert(0, name, int(rows[name].iloc[0]))
    return frame


class _Found:
    """The k best (score, id) so far: highest scores, then smallest ids."""

    def __init__(self, k: int, own: int):
        self.k, self.own, self.best = k, own, []  # heap of (score, -id), the worst first

    def worst(self) -> float:
        return self.best[0][0] if len(self.best) == self.k else -np.inf

    def offer(self, score: int, vec_id: int) -> None:
        if vec_id == self.own:
            return
        if len(self.best) < self.k:
            heapq.heappush(self.best, (score, -vec_id))
        elif (score, -vec_id) > self.best[0]:
            heapq.heapreplace(self.best, (score, -vec_id))


class Searcher:
    """Best-first search over the pages of one tree, for many queries at a time.

    ``longest`` is the greatest product of lengths of a query and a vector: no score, nor part of
    one, exceeds it. Scores are computed in doubles where those are exact, else in longs, else in
    whole numbers of any size.
    """

    def __init__(self, pages: pd.DataFrame, dimension: int, reach: float, longest: float):
        self.dimension, self.reach = dimension, reach
        pages = pages.sort_values("page").reset_index(drop=True)
        self.centers = np.stack([np.frombuffer(x) for x in pages["center"]])
        self.radius = pages["radius"].to_numpy()
        self.to_parent = pages["to_parent"].to_numpy()
        parents = pages["parent"].to_numpy()
        self.children = [np.flatnonzero(parents == p) for p in range(len(pages))]
        self.kind = np.float64 if longest < EXACT_DOUBLE else np.int64 if longest < EXACT_LONG / 2 else object
        self.rows = [np.frombuffer(x, dtype="<i8").reshape(-1, dimension).astype(self.kind) for x in pages["rows"]]
        self.to_center = [np.frombuffer(x) for x in pages["to_center"]]
        self.ids = [
            np.frombuffer(x, dtype="<i8").reshape(len(r), -1) if len(r) else None
            for x, r in zip(pages["ids"], self.rows, strict=True)
        ]
        self.leaves = [p for p, c in enumerate(self.children) if not len(c)]
        self.computed = 0

    def search(self, queries: np.ndarray, own: list[int], k: int, bars: list[int | None] | None = None) -> list[list[tuple[int, int]]]:
        """The k best (score, id) of each query, best first; those below its bar may be left out.

        Every query takes the tree's leaves in the order of their least possible distance, and stops
        at the first that cannot hold a better one; queries that want the same leaf share its reading.
        ``computed`` counts the distances and scores it took.
        """
        bars = bars or [None] * len(queries)
        points = np.column_stack([queries.astype(np.float64), np.zeros(len(queries))])
        exact = queries.astype(self.kind)
        length = np.einsum("ij,ij->i", points, points) + self.reach
        slack = 1e-7 * (1.0 + np.sqrt(length))
        found = [_Found(k, i) for i in own]
        limit = np.full(len(queries), np.inf)
        # what a score must reach; whole numbers stay what they are where doubles are not exact
        worst = np.full(len(queries), -np.inf, dtype=np.float64 if self.kind is np.float64 else object)

        def tighten(q: int) -> None:
            worst[q] = found[q].worst() if bars[q] is None else max(found[q].worst(), bars[q])
            if worst[q] > -np.inf:
                limit[q] = math.sqrt(max(length[q] - 2.0 * float(worst[q]), 0.0)) + slack[q]

        for q in range(len(queries)):
            tighten(q)
        place = {leaf: n for n, leaf in enumerate(self.leaves)}
        bound = np.full((len(queries), len(self.leaves)), np.inf)
        away = np.zeros_like(bound)
        everyone = np.arange(len(queries))
        distance = np.linalg.norm(points - self.centers[0], axis=1)
        self.computed += len(queries)
        pending = [(0, everyone, distance)]
        while pending:
            page, asked, distance = pending.pop()
            nearest = np.maximum(0.0, distance - self.radius[page])
            near = nearest <= limit[asked]
            asked, distance = asked[near], distance[near]
            if page in place:
                bound[asked, place[page]], away[asked, place[page]] = nearest[near], distance
                continue
            for child in self.children[page].tolist() if len(asked) else ():
                # stored distances rule pages out before their own distance is computed
                open_to = np.abs(distance - self.to_parent[child]) - self.radius[child] <= limit[asked]
                chosen = asked[open_to]
                if len(chosen):
                    self.computed += len(chosen)
                    pending.append((child, chosen, np.linalg.norm(points[chosen] - self.centers[child], axis=1)))
        order = np.argsort(bound, axis=1, kind="stable")
        going = everyone
        for turn in range(len(self.leaves)):
            wanted = order[going, turn]
            going, wanted = (x[bound[going, wanted] <= np.minimum(limit[going], np.finfo(float).max)] for x in (going, wanted))
            if not len(going):
                break
            for leaf in np.unique(wanted).tolist():
                for q in self._read(leaf, going[wanted == leaf], away, exact, limit, worst, found, k):
                    tighten(q)
        return [sorted(((s, -i) for s, i in f.best), key=lambda x: (-x[0], x[1])) for f in found]

    def _read(self, place: int, asked: np.ndarray, away, exact, limit, worst, found: list[_Found], k: int) -> list[int]:
        """Score the rows of a leaf that stored distances don't rule out for all of ``asked``; gives the queries that gained."""
        leaf = self.leaves[place]
        distance = away[asked, place]
        low, high = (distance - limit[asked]).min(), (distance + limit[asked]).max()
        near = np.flatnonzero((self.to_center[leaf] >= low) & (self.to_center[leaf] <= high))
        if not len(near):
            return []
        scores = self.rows[leaf][near] @ exact[asked].T
        self.computed += scores.size
        gained = np.flatnonzero(scores.max(axis=0) >= worst[asked])
        for column in gained.tolist():
            own, best = scores[:, column], found[asked[column]]
            hits = np.flatnonzero(own >= worst[asked[column]])
            if len(hits) > 4 * k and self.kind is not object:
                # one of the best k + 1 rows may be the query itself
                hits = hits[own[hits] >= np.partition(own[hits], -(k + 1))[-(k + 1)]]
            for i in sorted(hits.tolist(), key=lambda i: -own[i]):
                if own[i] < best.worst():
                    break
                known = self.ids[leaf][near[i]]
                for vec_id in known[1 : 1 + known[0]].tolist():
                    best.offer(int(own[i]), vec_id)
        return asked[gained].tolist()


def _nearest(vectors: np.ndarray, pivots: np.ndarray, reach: float) -> np.ndarray:
    """Distances of rows to all pivots, both lifted."""
    squares = np.einsum("ij,ij->i", vectors, vectors)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :]
    return np.sqrt(np.maximum(squares - 2 * vectors @ pivots.T, 0.0))


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    tree_rows: int = 16_384,
    page_rows: int = 256,
    fanout: int = 16,
    query_rows: int = 4_096,
    most_pivots: int = 4_096,
) -> DataFrame:
    """For each query the ``k`` vectors of highest inner product, exactly.

    Components x become floor(``scale`` * x), and scores are whole numbers, exact at any size; a score
    or component beyond a long is an error; vectors may have any number of components. Inner product search becomes search by distance with one more
    component per vector. Vectors are dealt to their nearest pivots, of which there are as many as
    trees of ``tree_rows``, at most ``most_pivots`` or 64 MB, chosen by hash; a pivot's cell of more rows
    has several trees. Trees are built once and written as pages.

    A query first asks one tree of its nearest cell. Its k-th score there, the radii of the cells
    and the bisectors between pivots then rule out other cells; it asks all trees of those left, with
    that score as a bar. In a tree, the page of least possible distance comes first, and covering radii
    and stored distances to the parent's center rule out pages and rows without computing theirs.
    Queries meet a tree in blocks of ``query_rows``. Where vectors are so spread out that no cell can
    be ruled out, the work is queries times vectors, as exact search must be.

    Equal vectors share one entry with their k + 1 smallest ids, more of which no answer can need.
    Ties go to the smaller id. A query's own id is no candidate. Vectors that are null, empty or hold
    null or non-finite components take no part, nor do rows without id; repeated rows count once; a query
    meets vectors of its own dimension; columns of other names play no part. Returns query_id, rank
    (from 1), vec_id, score; queries with fewer candidates return all of them, an empty table nothing.
    """

    def read(df: DataFrame) -> DataFrame:
        return (
            df.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("vector"))
            .filter("id IS NOT NULL AND vector IS NOT NULL")
            .withColumns({"k1": F.xxhash64(F.lit(1), "vector"), "k2": F.xxhash64(F.lit(2), "vector")})
        )

    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("length")
    smallest = W.partitionBy("k1", "k2").orderBy("id")
    entries = staged(
        read(vectors)
        .groupBy("id", "k1", "k2")
        .agg(F.first("vector").alias("vector"))
        .withColumn("nth", F.row_number().over(smallest))
        .filter(F.col("nth") <= k + 1)
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector"))
        .select(
            F.size("vector").alias("dimension"),
            F.xxhash64("k1", "k2").alias("key"),
            "ids",
            F.col("ids")[0].alias("first"),
            "vector",
            length,
        ),
        "topk-entries",
    )
    asked = staged(
        read(queries).groupBy("id").agg(F.min("vector").alias("vector")).select("id", "vector", F.size("vector").alias("dimension"), length),
        "topk-queries",
    )
    size, furthest, widest = entries.agg(F.count(F.lit(1)), F.max("length"), F.max("dimension")).first()
    count, longest = asked.agg(F.count(F.lit(1)), F.max("length")).first()
    reach = float(furthest or 0.0)
    # a little more than the product of lengths, for their rounding
    longest = 1.0001 * math.sqrt(reach) * math.sqrt(float(longest or 0.0))
    widest = widest or 1

    wanted = max(1, min(-(-size // tree_rows), most_pivots, 64_000_000 // (8 * widest)))
    point = F.pmod(F.xxhash64("key", F.lit("pivot")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = entries.filter(point <= min(1.0, 8 * (wanted + 8) / max(size, 1))).orderBy("key").limit(wanted).select("dimension", "vector").toPandas()
    pivots = {
        int(dimension): lifted(np.stack(own["vector"].to_list()).astype(np.float64), reach)
        for dimension, own in some.groupby("dimension")
    }
    shared = entries.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("cell int, away double")
    def nearest_cell(dimension: pd.Series, vector: pd.Series) -> pd.DataFrame:
        # a dimension without pivots is one cell of its own
        cells, away = np.full(len(vector), -1), np.zeros(len(vector))
        for size in dimension.unique():
            if size in shared.value:
                own = np.flatnonzero(dimension == size)
                distance = _nearest(lifted(np.stack(vector.iloc[own].to_list()).astype(np.float64), reach), shared.value[size], reach)
                cells[own] = distance.argmin(axis=1)
                away[own] = distance[np.arange(len(own)), cells[own]]
        return pd.DataFrame({"cell": cells, "away": away})

    dealt = staged(
        entries.withColumn("at", nearest_cell("dimension", "vector")).select("dimension", "key", "ids", "first", "vector", "at.*"),
        "topk-dealt",
    )
    # a tree of wide vectors has fewer of them
    own_rows = F.greatest(F.lit(page_rows), F.least(F.lit(tree_rows), F.floor(F.lit(4_000_000) / F.col("dimension"))))
    cells = staged(
        dealt.groupBy("dimension", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
        .withColumn("parts", F.ceil(F.col("n") / own_rows).cast("int"))
        .drop("n"),
        "topk-cells",
    )
    planted = dealt.join(sized(cells.drop("radius")), ["dimension", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("key", F.lit("part")), F.col("parts")).cast("int")
    )

    def build(own: pd.DataFrame) -> pd.DataFrame:
        return _build(own, reach, page_rows, fanout)

    tree = ["dimension", "cell", "part"]
    trees = planted.select(*tree, "ids", "first", "vector").groupBy(*tree).applyInPandas(build, PAGES)
    pages = staged(trees, "topk-pages")
    blocks = max(1, -(-count // max(64, min(query_rows, 4_000_000 // widest))))

    def search(key: tuple, own_queries: pd.DataFrame, own_pages: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(own_queries) and len(own_pages):
            searcher = Searcher(own_pages, int(key[0]), reach, longest)
            own = own_queries["id"].tolist()
            bars = [None if pd.isna(x) else int(x) for x in own_queries["bar"].astype(object)]
            found = searcher.search(np.stack(own_queries["vector"].to_list()).astype(np.int64), own, k, bars)
            out = [(i, vec_id, score) for i, best in zip(own, found, strict=True) for score, vec_id in best]
            if any(not -(2**63) <= score < 2**63 for _, _, score in out):
                raise OverflowError("a score is too large for a long")
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def meet(pairs: DataFrame) -> DataFrame:
        """Answers to pairs of a query and a tree: (id, vector, bar, dimension, cell, part)."""
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        keys = [*tree, "block"]
        # only trees and blocks that some query asks
        met = pairs.withColumn("block", block)
        spread = pages.join(met.select(*tree, F.col("block").alias("asked_by")).distinct(), tree)
        return met.groupBy(*keys).cogroup(spread.groupBy(*tree, "asked_by")).applyInPandas(search, "query_id long, vec_id long, score long")

    home = asked.withColumn("home", nearest_cell("dimension", "vector")["cell"])
    home = staged(home.select("id", "vector", "dimension", "home").withColumn("bar", F.lit(None).cast("long")), "topk-home")
    first = staged(meet(home.withColumnRenamed("home", "cell").withColumn("part", F.lit(0))), "topk-first")
    bars = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bar"))
    radii = {(r.dimension, r.cell): r.radius for r in cells.filter("cell >= 0").collect()}
    shared_radii = entries.sparkSession.sparkContext.broadcast(radii)

    @F.pandas_udf("array<int>")
    def open_cells(dimension: pd.Series, vector: pd.Series, bar: pd.Series) -> pd.Series:
        out: list = [[-1]] * len(vector)
        for size in dimension.unique():
            if size in shared.value:
                own = np.flatnonzero(dimension == size)
                rows = np.stack(vector.iloc[own].to_list()).astype(np.float64)
                distance = _nearest(np.column_stack([rows, np.zeros(len(rows))]), shared.value[size], reach)
                squares = np.einsum("ij,ij->i", rows, rows) + reach
                known = bar.iloc[own].to_numpy(dtype=np.float64)
                slack = 1e-6 * (1.0 + np.sqrt(squares))
                limit = np.where(np.isnan(known), np.inf, np.sqrt(np.maximum(squares - 2 * known, 0.0)) + slack)
                radius = np.array([shared_radii.value.get((size, c), -np.inf) for c in range(distance.shape[1])])
                # no nearer than the cell's rim, nor than the bisector with the nearest pivot
                least = np.maximum(distance - radius, (distance - distance.min(axis=1, keepdims=True)) / 2)
                for i, cells_left in zip(own.tolist(), least <= limit[:, None], strict=True):
                    out[i] = np.flatnonzero(cells_left).tolist()
        return pd.Series(out)

    rest = (
        home.drop("bar")
        .join(bars, "id", "left")
        .withColumn("cell", F.explode(open_cells("dimension", "vector", F.col("bar").cast("double"))))
        .join(sized(cells.drop("radius")), ["dimension", "cell"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .filter("cell != home OR part > 0")
        .select("id", "vector", "bar", *tree)
    )
    found = first.unionByName(meet(staged(rest, "topk-rest")))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all ``embeddings`` for each whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter("vec_id % 50 = 0"), vectors)


OP6_SQL = """
WITH vectors AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""
