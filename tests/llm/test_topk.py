"""Exact search against all inner products."""

import numpy as np
import pytest

from marlstone.llm.topk import MTree, Searcher, _build, lifted, op6_topk, top_k


def plain(rows, queries, k):
    vectors = {i: np.floor(256 * np.asarray(v, dtype=np.float64)).astype(int) for i, v in rows if v and None not in v and np.isfinite(v).all() and i is not None}
    out = set()
    for q in queries:
        if q in vectors:
            scored = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_equals_all_products(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((700, 8)))]
    rows += [(1000 + i, [0.5] * 8) for i in range(200)]  # ties
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (2005, [0.0] * 8)]
    rows += [(2006, [1.0, 2.0]), (2007, [3.0, 4.0]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows] + [(None, [1.0] * 8, 1)], "vec_id long, embedding array<float>, score int")
    queries = df.filter("vec_id % 50 = 0 OR vec_id > 1990")
    got = {tuple(r) for r in top_k(queries, df, tree_rows=200, page_rows=16, fanout=4, query_rows=10).collect()}
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == plain(floats, [i for i, _ in rows if i % 50 == 0 or i > 1990], 5)


def test_bounds_save_computations():
    import pandas as pd

    rng = np.random.default_rng(2)
    centers = rng.standard_normal((20, 6)) * 100
    points = np.round(np.repeat(centers, 100, axis=0) + rng.standard_normal((2000, 6)))
    reach = float((points**2).sum(axis=1).max())
    frame = pd.DataFrame({"dimension": 6, "cell": 0, "part": 0, "first": np.arange(2000), "ids": [np.array([i]) for i in range(2000)], "vector": list(points)})
    searcher = Searcher(_build(frame, reach, 32, 8), 6, reach, reach)
    best = searcher.search(points[7:8], [7], 5)[0]
    assert [s for s, _ in best] == sorted((points @ points[7])[np.arange(2000) != 7].tolist())[::-1][:5]
    assert searcher.computed < 1500


def test_tree_keeps_every_row_within_its_radius():
    points = lifted(np.random.default_rng(3).standard_normal((500, 3)), 100.0)
    tree = MTree(20, 4, 0).build(points)
    held = np.concatenate([own for _, _, _, _, own, _ in tree.pages])
    assert sorted(held.tolist()) == list(range(500))
    assert all((d <= r + 1e-9).all() for _, _, r, _, _, d in tree.pages)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, df).count() == 0


def test_exact_at_any_size(spark):
    rng = np.random.default_rng(8)
    for size in (1e6, 3e6, 4e6):
        rows = [(i, (np.full(12, size) + rng.integers(-5, 6, 12)).tolist()) for i in range(300)]
        rows += [(400 + i, v) for i, (_, v) in enumerate(rows[:20])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        queries = df.filter("vec_id % 50 = 0")
        if size == 4e6:
            with pytest.raises(Exception, match="too large for a long"):
                top_k(queries, df).collect()
            continue
        got = {tuple(r) for r in top_k(queries, df, tree_rows=100, page_rows=16, fanout=4).collect()}
        want = set()
        whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
        for q in [i for i in whole if i % 50 == 0]:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])}
        assert got == want


def test_far_cells_are_not_asked(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((8, 10)) * 40
    rows = [(i, (centers[i % 8] + rng.standard_normal(10)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.filter("vec_id % 50 = 0")
    got = {tuple(r) for r in top_k(queries, df, tree_rows=100, page_rows=16, fanout=4).collect()}
    floats = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == plain(floats, [i for i, _ in rows if i % 50 == 0], 5)


def test_query_on_embeddings(spark, small):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert {tuple(r) for r in op6_topk(spark, small).collect()} == plain(rows, [i for i, _ in rows if i % 50 == 0], 5)


def test_components_beyond_a_long_are_an_error(spark):
    def scores(*vectors):
        df = spark.createDataFrame([(50 * i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        return {(r.query_id, r.vec_id): r.score for r in top_k(df.filter("vec_id = 0"), df).collect()}

    for big in (1e17, 1e20, -1e20, 1e30):
        with pytest.raises(Exception, match="beyond"):
            scores([1 / 256, 0.0], [big, 0.0], [-0.5, big])
    big = 2.0**54  # 2 ** 62 after scaling, the largest power of two that fits with both signs
    got = scores([1 / 256, 0.0], [big, 0.0], [-big, 1.0])
    assert got[0, 50] == 2**62 and got[0, 100] == -(2**62)
    with pytest.raises(Exception, match="beyond"):
        scores([1.0, 0.0], [2.0**55, 0.0])
