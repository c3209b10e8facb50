"""Embedding near-duplicates against all cosines."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from marlstone.llm.embeddings import Forest, near_vectors, unit_rows


def plain(rows, least):
    good = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for size in {len(v) for _, v in good}:
        own = [(i, v) for i, v in good if len(v) == size]
        unit = unit_rows(np.array([v for _, v in own]))
        near = unit @ unit.T >= least
        for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            i, j = own[a][0], own[b][0]
            links[i] += 1
            links[j] += 1
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {(i, links[i], find(i), find(i) == i) for i, _ in rows}


def test_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((1500, 16)).astype(np.float32).tolist())]
    for i in range(200):
        for j in range(3):
            noise = rng.standard_normal(16) * 0.08
            rows.append((2000 + 3 * i + j, (np.array(rows[i][1]) + noise).astype(np.float32).tolist()))
    rows += [(5000 + i, rows[3][1]) for i in range(400)]  # many copies
    rows += [(8000, None), (8001, []), (8002, [0.0] * 16), (8003, [float("nan")] * 16), (8004, [None] * 16), (8005, [1.0, 0.0]), (8006, [1.0, 0.1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, node int")
    want = plain(rows, 0.9)
    got = {tuple(r) for r in near_vectors(df, leaf_rows=64, cell_rows=48).collect()}
    assert len(got) == len(rows)
    assert len(got & want) >= 0.995 * len(want)
    true, found = sum(x[1] for x in want), sum(x[1] for x in got)
    assert 0.99 * true <= found <= true


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0]), (1, [1.0]), (1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=str)
    assert near_vectors(df.limit(0)).count() == 0


def test_dense_group_ends_splitting_and_loses_no_links(spark, tmp_path):
    rng = np.random.default_rng(8)
    n, size, least = 21_000, 64, 0.9
    vectors = unit_rows(rng.standard_normal((n, size)))
    centre = unit_rows(rng.standard_normal((1, size)))
    dense = n // 3
    vectors[:dense] = np.sqrt(0.95) * centre + np.sqrt(0.05) * vectors[:dense]
    unit = unit_rows(vectors.astype(np.float32))
    forest = Forest(size).grow(unit, 1, n, 512, 0.5 * np.sqrt(0.2 / size), 7)
    placed = np.concatenate(forest.route(unit))
    assert forest.leaves < 400 and len(placed) < 6 * n and np.bincount(placed).max() < n / 2
    column = pa.FixedSizeListArray.from_arrays(pa.array(vectors.astype(np.float32).ravel()), size).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": column}), tmp_path / "dense.parquet")
    got = near_vectors(spark.read.parquet(str(tmp_path / "dense.parquet"))).toPandas().sort_values("vec_id")
    want = sum(int((unit[at : at + 1000] @ unit.T >= least).sum()) for at in range(0, n, 1000)) - n
    found = int(got["n_links"].sum())
    print(f"leaves {forest.leaves}, placements a row {len(placed) / n:.2f}, largest leaf {np.bincount(placed).max()}, links {found} of {want}")
    assert 0.999 * want <= found <= want
    assert (got["component_id"].to_numpy()[:dense] == 0).all()


def test_over_full_leaves_are_split_again(spark, monkeypatch):
    """A forest fitted to few rows leaves large leaves; split again, they are small, and links are still found."""
    from marlstone.llm import embeddings

    rng = np.random.default_rng(14)
    base = rng.standard_normal((3000, 32))
    near = base[:1500] + rng.standard_normal((1500, 32)) * 0.25
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    largest, split_again = [], embeddings._split_again

    def watched(routed, *rest):
        out, more = split_again(routed, *rest)
        sizes = lambda r: r.selectExpr("explode(leaves) AS leaf").groupBy("leaf").count().agg({"count": "max"}).first()[0]
        largest.append((sizes(routed), sizes(out), more))
        return out, more

    monkeypatch.setattr(embeddings, "_split_again", watched)
    monkeypatch.setattr(embeddings, "SPLIT_SAMPLE", 600)
    got = {r.vec_id: r for r in near_vectors(df, leaf_rows=64, sample_rows=120, cell_rows=128).collect()}
    assert largest[0][2] and largest[-1][1] < 0.6 * largest[0][0], largest
    want = {i: n for i, n, _, _ in plain(rows, 0.9)}
    assert all(r.n_links <= want[i] for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(want.values()) > 0
