"""Mixing: weights, budgets and permutations."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm.mixing import bisect_exponent, mix_sources, source_weights


def docs_of(spark, sizes):
    rows, n = [], 0
    for source, count in sizes.items():
        for i in range(count):
            rows.append((n, " ".join(["w"] * (1 + i % 9)), source, n))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens long")


def test_bisection_finds_the_edge():
    assert bisect_exponent(lambda x: x <= 0.3, False) == math.floor(0.3 * 1024) / 1024
    assert bisect_exponent(lambda x: x >= 0.3, True) == math.ceil(0.3 * 1024) / 1024
    assert bisect_exponent(lambda x: False, True) == 1 and bisect_exponent(lambda x: False, False) == 0


def test_entropy_target_is_met(spark):
    sources = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10), ("none", 0)], "source string, tokens long")
    weights, exponent = source_weights(sources, evenness=0.8)
    w = {r.source: r.weight for r in weights.collect()}
    assert abs(sum(w.values()) - 1) < 1e-12 and "none" not in w
    entropy = -sum(x * math.log(x) for x in w.values())
    assert entropy >= 0.8 * math.log(3) > entropy - 0.01 and 0 < exponent < 1


def test_budgets_and_permutations(spark):
    docs = docs_of(spark, {"big": 900, "small": 60, "tiny": 9})
    rows = mix_sources(docs, max_repeats=2.0, whole=True, block_docs=16).collect()
    tokens = {r.doc_id: 1 + len(r.text.split()) - 1 for r in docs.collect()}
    per = Counter(r.doc_id for r in rows)
    assert set(per) == set(tokens) and max(per.values()) <= 2
    streams = defaultdict(list)
    for r in rows:
        assert r.tokens == tokens[r.doc_id]
        streams[r.source].append(r)
    for own in streams.values():
        own.sort(key=lambda r: (r.epoch, r.block_rank, r.place))
        at = 0
        for r in own:  # a stream without gaps, epoch by epoch
            assert r.first_token == at
            at += r.tokens
        assert all(n == 1 for n in Counter((r.epoch, r.doc_id) for r in own).values())
    assert all(n == 1 for d, n in per.items() if next(r.source for r in rows if r.doc_id == d) == "big")


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "", "a"), (3, "x y z", "a"), (None, "gone", "a"), (4, "q", "b"), (None, None, "b")]
    rows += [(3, "another text", "b"), (3, "x y z", "c"), (None, "gone", "a"), (5, "long " * 300_000, "a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, name int, `a.b` int")
    got = mix_sources(docs, evenness=1.0, whole=True).collect()
    first = Counter((r.doc_id, r.text_md5) for r in got if r.epoch == 0)
    md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    assert first == {(d, md5(t)): 1 for d, t, _ in rows}
    assert {r.source for r in got if r.text_md5 == md5("x y z")} == {"a"}
    assert mix_sources(docs.limit(0), evenness=0.9).count() == 0
    with pytest.raises(ValueError):
        source_weights(docs.selectExpr("source", "doc_id AS tokens"))


def test_a_tiny_source_beside_a_huge_one(spark):
    """One word beside 10 ** 10 tokens: repeated as often as allowed, no overflow, no lost source."""
    rows = [(0, "word", "tiny", 1)] + [(i, "x", "huge", 5 * 10**6) for i in range(1, 2001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, own long")
    times = Counter(r.source for r in mix_sources(docs, evenness=0.999, tokens=F.col("own")).select("source").collect())
    assert 1 <= times["tiny"] <= 16 and times["huge"] > 1900
    sources = spark.createDataFrame([("a", 10**10), ("b", 1)], "source string, tokens long")
    assert source_weights(sources, evenness=1.0)[1] == 0 < source_weights(sources, evenness=1.0, max_repeats=4.0)[1]
