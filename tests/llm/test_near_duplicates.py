"""Near-duplicates against all pairs in Python."""

import random
import re
from collections import defaultdict

import pytest

from marlstone.llm.near_duplicates import CHUNK, chunks_for, near_duplicates, op4_minhash, signature_distances


def shingle_set(text, words):
    parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if len(parts) < words:
        return frozenset([tuple(parts)]) if parts else frozenset()
    return frozenset(tuple(parts[i : i + words]) for i in range(len(parts) - words + 1))


def plain(rows, words, percent):
    sets = [(d, shingle_set(t, words)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for own in holders.values():
        for j, a in enumerate(own):
            for b in own[:j]:
                common[b, a] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = find(sets[a][0]), find(sets[b][0])
            root[max(x, y)] = min(x, y)
    return {(d, len(s), find(d), find(d) == d) for d, s in sets}


def test_query_on_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {tuple(r) for r in op4_minhash(spark, small).collect()}
    assert got == plain(rows, 3, 85)


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_chains_and_many_copies(spark, words, percent):
    rng = random.Random(words)
    rows, n = [], 0
    for _ in range(12):
        text = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 30, 300]))]
        for _ in range(25):
            rows.append((n, " ".join(text)))
            n += 1
            text = edited(rng, text, rng.choice([0, 0.005, 0.02]))
    rows += [(n + i, "One  big\tGROUP of copies of this text") for i in range(300)]
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "two words"), (5004, "TWO words"), (5005, "one"), (5006, "x" * 100_000)]
    docs = spark.createDataFrame([(d, t, d, "k") for d, t in rows], "doc_id long, text string, node long, component string")
    # cells so small that groups are cut into blocks
    got = {tuple(r)[:4] for r in near_duplicates(docs, words, percent, cell_docs=16).collect()}
    assert got == plain(rows, words, percent)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "A b c d e f")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(docs).drop("text_hash").collect()), key=str)
    assert got == sorted([(None, 2, None, True, True), (7, 2, 7, True, True), (7, 2, 7, True, True), (8, 2, 7, False, False)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_repeated_ids_with_different_texts(spark):
    rows = [(3, "a b c d e f g"), (7, "a  b c d e f g"), (7, "quite another text of its own"), (7, "A b c d e f g h"), (9, None), (9, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.chosen) for r in got) == [
        (3, 5, 3, True), (7, 4, 7, True), (7, 5, 3, False), (7, 6, 3, False), (9, 0, 9, True), (9, 0, 9, True)
    ]


def test_clashing_columns_and_a_very_long_text(spark):
    names = "text_hash key node component group signature set_id low high kept chosen".split()
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "short text of its own words")]
    docs = spark.createDataFrame([(d, t, *names) for d, t in rows], ["doc_id", "text", *names])
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_pairs_under_the_signature_distance_share_a_key():
    import numpy as np

    rng, chunks = np.random.default_rng(3), chunks_for(80)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, CHUNK * chunks, dtype=np.uint16)
        b = a.copy()
        b[rng.choice(len(a), 2 * chunks - 1, replace=False)] += 1
        assert signature_distances(np.stack([a, b]))[0, 1] == 2 * chunks - 1
        assert ((a != b).reshape(chunks, CHUNK).sum(axis=1) <= 1).any()


def test_a_large_group_beside_what_resembles_it(spark):
    """Copies that differ by one word, and texts at about the threshold from many of them, in small cells."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(rng.choices(range(120), k=260))]
    rows += [(1000 + i, " ".join(base[: 120 - 3 * i] + [f"y{i}z{j}" for j in range(3 * i)])) for i in range(1, 12)]
    rows += [(2000 + i, " ".join(f"t{i % 3}v{j}" if j % 7 else f"u{i}v{j}" for j in range(80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 93):
        got = {tuple(r)[:4] for r in near_duplicates(docs, 3, percent, cell_docs=8).collect()}
        assert got == plain(rows, 3, percent)


def test_chunks_follow_the_threshold():
    assert chunks_for(85) < chunks_for(80) < chunks_for(70)
