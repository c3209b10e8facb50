"""Collocations against counting everything, with samples that miss much."""

import random
import re
from collections import Counter

import numpy as np

from marlstone.llm import collocations as module
from marlstone.llm.collocations import collocations, filter_of, mine, stretches


def plain_pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", piece) for piece in re.split("[.,;:!?\x0a-\x0d]", text)]


def plain_counts(rows):
    counts = Counter()
    for lang, text in rows:
        for words in plain_pieces(text):
            for size in (1, 2, 3):
                counts.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return counts


def plain(rows, least, most):
    counts = plain_counts(rows)
    totals = Counter()
    for (lang, words), f in counts.items():
        totals[lang] += f * (len(words) == 1)
    wanted = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    out = {}
    for (lang, words), a in wanted.items():
        if any(100 * f >= 50 * a for (o, w), f in wanted.items() if o == lang and len(w) == 3 and len(words) == 2 and words in (w[:2], w[1:])):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return {
        (lang, n + 1, phrase.decode(), -a, l, r, totals[lang], -score)
        for lang, found in out.items()
        for n, (score, a, phrase, l, r) in enumerate(sorted(found)[:most])
    }


def texts(seed, count=300):
    rng = random.Random(seed)
    words = ["the", "Of", "straße", "a-b", "$", "é", *(f"w{i}" for i in range(60))]
    ends = [" "] * 8 + [", ", ".", "\n", "\t", "  ", "\x0b", "! ", "\x1c", " "]
    return [
        ("".join(rng.choice(words[: 3 + i % 60]) + rng.choice(ends) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]))
        for i in range(count)
    ]


def test_equals_counting_everything(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(texts(1))]
    rows += [(None, None, "en"), (None, "", "en"), (5, " ., ", None), (6, "rare pair here. " * 30, "only"), (7, "x y z " * 4000, "long")]
    rows += [(8, "red hot iron, ", "de")] * 12 + [(9, "tie one. tie two. ", "en")] * 10
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, phrase string")
    got = collocations(docs.repartition(6), most=40).collect()
    assert {tuple(r) for r in got} == plain([(lang, t) for _, t, lang in rows], 10, 40) and len(got) == len(set(got))


def test_any_sample_gives_all(spark):
    """Nothing proposed, little, and everything: the border and its passes make up for what the sample misses."""
    rows = [(lang or "und", t.encode(), i / 300) for i, (t, lang) in enumerate(texts(2))]
    df = spark.createDataFrame(rows, "lang string, text binary, point double").repartition(3)
    want = {(lang, " ".join(w)): f for (lang, w), f in plain_counts([(r[0], r[1].decode()) for r in rows]).items() if f >= 8}
    for share, lowered in ((0.0, 1.0), (0.02, 1.0), (0.3, 3.0), (1.0, 0.1)):
        found = mine(df, 8, share, lowered).filter("n >= 8").collect()
        assert len(found) == len(want) and {(r.lang, bytes(r.phrase).decode()): r.n for r in found} == want


def test_full_filters_and_small_stretches(spark, monkeypatch):
    """Counts stay exact if filters let all through, and if words, lists and counters are cut."""
    rows = [("en", t.encode(), i / 80) for i, (t, _) in enumerate(texts(3, 80))]
    want = {" ".join(w): f for (_, w), f in plain_counts([("en", r[1].decode()) for r in rows]).items() if f >= 4}
    batch = spark.createDataFrame(rows, "lang string, text binary, point double").select("lang", "text").toArrow().to_batches()
    for name, value in (("STRETCH", 50), ("MOST_WORDS", 20), ("MOST_GRAMS", 100)):
        monkeypatch.setattr(module, name, value)
    full = module.Filter(np.full(8, 255, dtype=np.uint8))
    found = Counter()
    for part in module._count(iter(batch), module.Wanted(True, words=full, pairs=full)):
        for phrase, n in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
            found[phrase.decode()] += n
    assert {k: n for k, n in found.items() if n >= 4} == want


def test_filter_misses_nothing(spark):
    phrases = [("en", w.encode()) for i in range(3000) for w in (f"a{i}", f"a{i} b{i % 7}")]
    held = filter_of(spark.createDataFrame(phrases, "lang string, phrase binary"))
    one = module.hashed("en", [f"a{i}".encode() for i in range(3000)])
    two = module.joined(one, module.hashed("en", [f"b{i % 7}".encode() for i in range(3000)]))
    assert held.has(one).all() and held.has(two).all()
    assert held.has(module.hashed("en", [f"c{i}".encode() for i in range(3000)])).mean() < 0.05
    assert held.has(module.hashed("de", [f"a{i}".encode() for i in range(3000)])).mean() < 0.05


def test_stretches_and_empty(spark):
    assert [w for s in stretches(b"A.b\tc  D;e") for w in s] == [b"a", b".", b"b", b"c", b"d", b".", b"e"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations(docs).count() == 0
