"""Shards: balance in all dimensions, gapless slots, groups together."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from marlstone.llm.sharding import WEIGHTS, op3_sharding, place, shard_documents


def test_place_goes_where_the_dot_product_is_highest():
    vectors = np.array([[4.0, 1.0], [1.0, 4.0], [4.0, 1.0], [1.0, 4.0]])
    got, left = place(vectors, np.full((2, 2), 5.0))
    assert np.allclose(left, 0)
    assert sorted(got[[0, 2]].tolist()) == [0, 1] and sorted(got[[1, 3]].tolist()) == [0, 1]


def check(rows, texts, shards):
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) <= set(range(shards))


def test_balance_and_groups(spark, small):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = op3_sharding(spark, small).collect()
    check(rows, texts, 8)
    by_id = dict(texts)
    sizes = Counter()
    for r in rows:
        data = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < mean + max(r.size for r in rows)
    shards_of = defaultdict(set)
    for r in rows:
        shards_of[by_id[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in shards_of.values())


def test_light_groups_stay_together_and_heavy_ones_are_split(spark):
    rows = [(i, "hot text of some length") for i in range(3000)] + [(10_000 + i, f"text {i % 1000} " * (1 + i % 7)) for i in range(4000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(got, rows, 4)
    by_id, shards_of = dict(rows), defaultdict(set)
    for r in got:
        shards_of[by_id[r.doc_id]].add(r.shard)
    assert len(shards_of["hot text of some length"]) > 1
    assert all(len(s) == 1 for t, s in shards_of.items() if not t.startswith("hot"))
    for dimension in ("size", "tokens"):
        sums = Counter()
        for r in got:
            sums[r.shard] += r[dimension]
        assert max(sums.values()) < 1.03 * sum(sums.values()) / 4
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) < 1.03 * len(got) / 4


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, None, 2), (1, None, 2), (2, "", 3), (3, "a" * 200_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    check(shard_documents(docs, 2).collect(), [(d, t) for d, t, _ in rows], 2)
    assert shard_documents(docs.limit(0), 2).count() == 0


def test_groups_that_fit_into_a_shard_stay_whole(spark):
    rows = [(i, "a") for i in range(1600)] + [(5000 + i, f"some words {i % 10} " * 20) for i in range(3000)]
    rows += [(20_000 + i, f"text {i} of its own " * 15) for i in range(11_400)]
    rows += [(40_000 + i, "far too many") for i in range(4000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check(got, rows, 8)
    by_id, shards_of, sizes = dict(rows), defaultdict(set), Counter()
    for r in got:
        shards_of[by_id[r.doc_id]].add(r.shard)
        sizes[r.shard] += r.size
    assert [t for t, s in shards_of.items() if len(s) > 1] == ["far too many"]
    assert max(sizes.values()) < 1.03 * sum(sizes.values()) / 8
    counts = Counter(r.shard for r in got)
    print("rows of the largest shard over the mean", max(counts.values()) * 8 / len(got))
    assert max(counts.values()) < 2 * len(got) / 8


def test_place_equals_a_plain_loop():
    """Largest first, each to the shard whose residual capacity gives the highest weighted dot product."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        vectors = np.round(rng.pareto(1.5, (60, 3)) * 100) + 1
        room = np.tile(vectors.sum(axis=0) / 5, (5, 1))
        mean, left, want = room.mean(axis=0), (room / room.mean(axis=0)).tolist(), {}
        for i in sorted(range(60), key=lambda i: -sum(vectors[i] / mean)):
            own = (vectors[i] / mean).tolist()
            scores = [sum(r * x * w for r, x, w in zip(residual, own, WEIGHTS)) for residual in left]
            best = max(range(5), key=lambda s: (round(scores[s], 12), -s))
            left[best] = [r - x for r, x in zip(left[best], own)]
            want[i] = best
        got, residual = place(vectors, room)
        assert np.mean([got[i] == want[i] for i in range(60)]) == 1 and np.allclose(residual, np.array(left) * mean)


def test_hot_rows_without_id_are_dealt(spark):
    rows = [(None, "one and the same") for _ in range(4000)] + [(i, f"text {i} " * 5) for i in range(2000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(got, rows, 4)
    counts = Counter(r.shard for r in got)
    assert len(counts) == 4 and max(counts.values()) < 1.1 * len(got) / 4


def test_columns_of_any_name_play_no_part(spark):
    names = "size tokens group row part shard slot heavy bin".split()
    docs = spark.createDataFrame([(i, f"text {i}", *names) for i in range(20)], ["doc_id", "text", *names])
    check(shard_documents(docs, 2).collect(), [(i, f"text {i}") for i in range(20)], 2)


def test_query_equals_a_plain_version(spark, small):
    """The whole of the query in plain Python: groups of equal texts, heavy ones first, the rest in one bin."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    groups = defaultdict(lambda: [0, 0, 0])
    for text in docs.values():
        own = groups[hashlib.md5(text.encode()).digest()]
        own[0] += len(text.encode()) + 1
        own[1] += len(re.findall(r"\S+", text, re.ASCII))
        own[2] += 1
    totals = [sum(x[k] for x in groups.values()) for k in range(3)]
    share = {g: max(x / t for x, t in zip(v, totals)) for g, v in groups.items()}
    assert max(share.values()) * 8 <= 1  # no group must be split
    unit = {g: [8 * x / t for x, t in zip(v, totals)] for g, v in groups.items()}
    left, want = [[1.0] * 3 for _ in range(8)], {}
    for heavy in (True, False):
        for g in sorted(sorted(g for g in groups if (share[g] * 8 * 64 > 1) == heavy), key=lambda g: -round(sum(unit[g]), 12)):
            scores = [sum(r * x * w for r, x, w in zip(residual, unit[g], WEIGHTS)) for residual in left]
            best = max(range(8), key=lambda s: (round(scores[s], 12), -s))
            left[best] = [r - x for r, x in zip(left[best], unit[g])]
            want[g] = best
    got = {r.doc_id: r for r in op3_sharding(spark, small).collect()}
    assert {d: r.shard for d, r in got.items()} == {d: want[hashlib.md5(t.encode()).digest()] for d, t in docs.items()}
    for shard in range(8):
        own = sorted(d for d, r in got.items() if r.shard == shard)
        assert {r.slot for r in got.values() if r.shard == shard} == set(range(len(own)))
