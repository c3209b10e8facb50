"""All of the pipeline against a version in plain Python, stage by stage from the same documents."""

import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as p
from marlstone.llm.secrets import ENCODINGS, MOST_STEPS, STEPS, STRATA, TEXT_CHANGES, TEXT_CORRELATION
from tests.llm.test_language import plain_buckets
from tests.llm.test_near_duplicates import plain as plain_classes
from tests.llm.test_packing import plain_ids
from tests.llm.test_secrets import base


def plain_languages(docs):
    """Documents of a language that naive Bayes finds likelier than not."""
    counts, docs_of = defaultdict(Counter), Counter()
    grams = {d: Counter(plain_buckets(r.text)) for d, r in docs.items() if r.text is not None}
    for d, r in docs.items():
        if r.text is not None and r.lang is not None:
            counts[r.lang].update(grams[d])
            docs_of[r.lang] += 1
    whole = {x: sum(c.values()) + 0.1 * (1 << 16) for x, c in counts.items()}

    def sure(d, text):
        if not text or not any(map(str.isalpha, text)):
            return False
        joint = [
            math.log(docs_of[x] / sum(docs_of.values())) + sum(n * math.log((counts[x][b] + 0.1) / whole[x]) for b, n in grams[d].items())
            for x in sorted(counts)
        ]
        return 1 / sum(math.exp(j - max(joint)) for j in joint) >= 0.5

    return {d: r for d, r in docs.items() if sure(d, r.text)}


def normal_nats(z):
    if z <= 0:
        return 0.0
    return z * z / 2 + math.log(math.sqrt(2 * math.pi)) - math.log(4 / (3 * z + math.sqrt(z * z + 8)))


def plain_steps(value):
    """Steps of evidence that ``value`` is random: the least of the three tests."""
    fitting = [(abc, chance) for pattern, abc, chance in ENCODINGS.values() if re.search(pattern, value)]
    own = re.sub("=+$", "", value).translate(str.maketrans("-_", "+/"))
    if not fitting or len(own) < 8:
        return 0
    (abc, chance), n = fitting[0], len(own)
    letters = len(abc)
    away = (n - 1) * (letters * chance - 1)
    mean = letters - 1 + away
    spread = 2 * (1 + away / mean) / (9 * mean)
    statistic = letters / n * sum(k * k for k in Counter(own).values()) - n
    uniform = normal_nats((1 - spread - (statistic / mean) ** (1 / 3)) / math.sqrt(spread))

    kinds = [0 if "0" <= c <= "9" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 for c in own]
    s, q = sum(x != y for x, y in zip(kinds, kinds[1:])) / (n - 1), TEXT_CHANGES
    if s <= q:
        runs = 0.0
    else:
        runs = (n - 1) * (math.log(1 / q) if s >= 1 else s * math.log(s / q) + (1 - s) * math.log((1 - s) / (1 - q)))

    ranks = np.array([abc.find(c.lower() if letters < 64 else c) + 1 for c in own], dtype=np.float64)
    x, y = ranks[:-1], ranks[1:]
    r = abs(np.corrcoef(x, y)[0, 1]) if x.std() and y.std() else 1.0
    serial = 0.0 if r >= TEXT_CORRELATION else normal_nats((math.atanh(TEXT_CORRELATION) - math.atanh(r)) * math.sqrt(n - 4))
    return int(min(uniform, runs, serial, MOST_STEPS // STEPS) * STEPS)


def plain_redacted(texts, rate=0.01):
    """Texts with a mark for each secret of a known form or that the randomness tests discover in them all."""
    known = {d: base(t or "") for d, t in texts.items()}
    free = defaultdict(list)
    for d, t in texts.items():
        for run in re.finditer("[A-Za-z0-9+/_=-]+", t or ""):
            for part in re.finditer("[A-Za-z0-9+/_-]+(=+$)?", run[0]):
                start, end = run.start() + part.start(), run.start() + part.end()
                if end - start >= 20 and not any(s < end and start < e for s, _, e in known[d]):
                    free[d].append((start, end, part[0]))
    stratum = lambda v: sum(len(v) >= x for x in STRATA)
    steps = {v: plain_steps(v) for own in free.values() for _, _, v in own}
    found = set()
    for level in {stratum(v) for v in steps}:
        own = sorted((v for v in steps if stratum(v) == level), key=lambda v: -steps[v])
        good = [v for v in own if math.exp(-steps[v] / STEPS) <= rate * sum(steps[w] >= steps[v] for w in own) / len(own)]
        found |= {v for v in own if good and steps[v] >= min(steps[w] for w in good)}
    out = {}
    for d, t in texts.items():
        hidden, done, text = [(s, e) for s, _, e in known[d]] + [(s, e) for s, e, v in free[d] if v in found], 0, ""
        for s, e in sorted(hidden):
            if s >= done:
                text += t[done:s] + "[SECRET]"
            done = max(done, e)
        out[d] = text + t[done:] if hidden else t
    return out, found


def plain_mix(texts, sources):
    """How often each document occurs: weights by a bisected temperature, no source more than twice."""
    tokens = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts.items()}
    of = defaultdict(list)
    for d in texts:
        of[sources[d] or ""].append(d)
    sums = {s: sum(tokens[d] for d in own) for s, own in of.items()}
    share = {s: n / sum(sums.values()) for s, n in sums.items() if n}
    for k in range(1025):  # the lowest exponent that will do, without bisection
        repeats = [x ** (k / 1024) / x for x in share.values()]
        if max(repeats) / min(repeats) <= 2:
            break
    z = sum(x ** (k / 1024) for x in share.values())
    weight = {s: x ** (k / 1024) / z for s, x in share.items()}
    budget = max(sums[s] / w for s, w in weight.items())
    times = Counter()
    for s, own in of.items():
        goal = max(sums[s], math.floor(weight[s] * budget + 0.5)) if s in weight else 0
        full, rest = divmod(goal, sums[s]) if sums[s] else (1, 0)
        at, places = 0, sorted(own, key=lambda d: (hashlib.md5(f"mix:{full}:{d}".encode()).hexdigest(), d))
        for d in places:
            times[d] += full + (at < rest)
            at += tokens[d]
    return times


def test_run_equals_plain_python(spark, small, tmp_path):
    rows = [r for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r.text or "") < 3000]
    rng = random.Random(3)
    alphabet = string.ascii_letters + string.digits + "+/"
    words = "the house by the river was sold in spring and nobody knows who lives there now or why".split()
    for i in range(12):
        rng.shuffle(words)
        value = "".join(rng.choices(alphabet, k=44)) if i % 3 else "a_name_of_more_than_twenty_letters"
        text = f"{' '.join(words)} {value} and {' '.join(reversed(words))}" + (" password: hunter22" if i % 2 else "")
        rows.append((500_000 + i, text, "en", "src-new", len(text)))
    rows += [(600_000, None, "en", "src0", None), (600_001, "12 34 56", "en", "src0", 8)]
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    # blocks and their order need more than a thousand documents of a source, which op5's SQL covers
    p.staged(spark.createDataFrame(rows, schema).coalesce(1), "plain", f"{tmp_path}/documents.parquet")

    docs = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    sure = plain_languages(docs)
    assert 0 < len(sure) < len(docs)
    classes = plain_classes([(d, r.text) for d, r in sure.items()], 5, 80)
    kept = {d: sure[d] for d, _, _, chosen in classes if chosen}
    assert 0 < len(kept) < len(sure)
    texts, found = plain_redacted({d: r.text for d, r in kept.items()})
    assert len(found) >= 6 and "a_name_of_more_than_twenty_letters" not in found
    times = plain_mix(texts, {d: r.source for d, r in kept.items()})
    assert set(times) == set(kept) and set(times.values()) == {1, 2}

    ids = dict(zip(texts, plain_ids(list(texts.values())), strict=True))
    pieces, covered, ends = p.run(spark, str(tmp_path)).collect(), {d: np.zeros(len(x), dtype=int) for d, x in ids.items()}, defaultdict(int)
    assert {r.doc_id for r in pieces} == set(ids)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes()
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
        covered[r.doc_id][r.start : r.start + r.length] += 1
    assert all((c == times[d]).all() for d, c in covered.items())
    assert max(ends.values()) <= 2048
