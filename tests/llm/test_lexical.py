"""Ranked lexical search against scoring every document for every query."""

import math
import random
import re
from collections import Counter

import numpy as np

from marlstone.llm.lexical import MOST_TIMES, counted, index, search, sketch, terms_in, _Places

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, queries, depth):
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    total, df = sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = set()
    for item, terms in asked.items():
        scored = []
        for d, c in held:
            m = 100 - 50 + 50 * c.total() * len(held) // total
            w = {t: math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) for t in terms if t in c}
            scored.append((sum(w[t] * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in w), d))
        best = sorted((-s, d is None, d or 0) for s, d in scored if s > 0)[:depth]
        out |= {(item, n + 1, None if null else d, -s) for n, (s, null, d) in enumerate(best)}
    return out


def test_terms():
    text = "Ab-9 ÄÖ\x00x_y~z q İ"
    assert [t.decode() for part in terms_in(text.encode()) for t in part] == plain_terms(text)
    assert not counted(None) and not counted(b"") and not counted(b" .,-")
    assert counted(b"word " * 1_000_000) == {b"word": 1_000_000}


def test_sketch_holds_the_largest():
    found = Counter({str(i).encode(): i % 300 + 1 for i in range(500)})
    places = _Places(64)
    at, tf = (np.frombuffer(x, k) for x, k in zip(sketch(found, places), ("<u4", np.uint8), strict=True))
    want = {}
    for t, n in found.items():
        want[places[t]] = max(want.get(places[t], 0), min(n, MOST_TIMES))
    assert dict(zip(at.tolist(), tf.tolist(), strict=True)) == want


def test_equals_scoring_everything(spark):
    """Few coordinates, so that most bounds are far from the scores; many copies, ties, odd rows, several blocks."""
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(600)]
    docs += [(1000 + i, docs[5][1]) for i in range(150)] + [(5, docs[5][1]), (None, docs[5][1]), (None, "w1 w2"), (7, "W1, w1!")]
    docs += [(2000, None), (2001, ""), (2002, " .;- "), (2003, "w1 " * 90_000 + "w2"), (2004, "w3 " * 300)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(40)]
    queries += [(40, docs[5][1]), (41, None), (42, ""), (43, "unheard-of"), (3, "w7 w8"), (None, "w1 w5"), (44, "w1 " * 1000)]
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, text_id string, `a.n` int")
    q = spark.createDataFrame([(i, t, 1.0) for i, t in queries], "item_id int, text string, score double")
    want = plain(docs, queries, 20)
    for coordinates, terms in ((32, 150), (1 << 16, 8000)):
        got = search(index(d.repartition(5), coordinates=coordinates), q, "item_id", depth=20, terms_a_block=terms, first_wave=1)
        got = got.collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([("i", "a")], "item string, text string")
    assert [tuple(r)[:3] for r in search(index(d), q, "item").collect()] == [("i", 1, 1)]
    assert search(index(d.limit(0)), q, "item").count() == 0
    assert search(index(d), q.limit(0), "item").count() == 0
