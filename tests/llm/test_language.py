"""Language ID: held-out accuracy and odd texts."""

import math
import zlib
from collections import Counter, defaultdict

from marlstone.llm.language import held_out, op8_language, predict, train
import pytest
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op8_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", held_out(F.col("doc_id")).alias("h")).collect()
    assert len(got) == len(docs) and all(got[r.doc_id].held_out == r.h for r in docs)
    out = [r for r in docs if r.h and got[r.doc_id].lang_pred != "und"]
    assert len(out) > 100 and sum(got[r.doc_id].lang_pred == r.lang for r in out) / len(out) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_texts(spark, small):
    model = train(spark.read.parquet(f"{small}/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the"), (4, "the"), (None, "and the of"), (5, "the and " * 90_000), (6, "日本")]
    got = predict(spark.createDataFrame([(d, t, 0.0) for d, t in rows], "doc_id long, text string, score double"), model).collect()
    pred = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows)
    assert [pred[i] for i in (1, 2, 3)] == ["und"] * 3
    assert pred[5] == "en" and pred[6] in model.languages


def test_long_texts_score_like_their_parts(spark, small):
    model = train(spark.read.parquet(f"{small}/documents.parquet"))
    text = "le la de et un " * 40_000
    single = model.log_likelihoods([text])[0]
    joined = model.log_likelihoods(["a b", text, "c"])[1]
    assert abs(single - joined).max() < 1e-6 * abs(single).max()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert predict(docs, train(docs)).first().lang_pred == "und"
    assert predict(docs.limit(0), train(docs.limit(0))).count() == 0


def plain_buckets(text, sizes=(1, 2, 3), bits=16):
    """Hash buckets of all n-grams of a text, one by one in whole numbers."""
    codes, wrap = [ord(c) for c in f" {text.lower()} "], (1 << 64) - 1
    for n in sizes:
        for at in range(len(codes) - n + 1):
            value = n
            for c in codes[at : at + n]:
                value = (value * 0x9E3779B97F4A7C15 + c) & wrap
                value ^= value >> 29
            yield ((value * 0xBF58476D1CE4E5B9) & wrap) >> (64 - bits)


def test_query_equals_plain_naive_bayes(spark, small):
    """All of the query by plain Python: every label's documents are learnt, as there are fewer than the sample's bound."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert max(len(r.text or "") for r in rows) > 3000
    counts, docs_of = defaultdict(Counter), Counter()
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang].update(plain_buckets(r.text))
            docs_of[r.lang] += 1
    langs, all_docs = sorted(counts), sum(docs_of.values())
    whole = {x: sum(counts[x].values()) + 0.1 * (1 << 16) for x in langs}

    def judge(text):
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        found = Counter(plain_buckets(text))
        joint = [math.log(docs_of[x] / all_docs) + sum(n * math.log((counts[x][b] + 0.1) / whole[x]) for b, n in found.items()) for x in langs]
        best = max(range(len(langs)), key=lambda i: (joint[i], -i))
        return langs[best], 1 / sum(math.exp(j - joint[best]) for j in joint)

    got = op8_language(spark, small).collect()
    assert len(got) == len(rows)
    texts = {r.doc_id: r.text for r in rows}
    for r in got:
        lang, score = judge(texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6, (r, lang, score)


def test_ties_go_to_the_language_that_sorts_first(spark):
    docs = spark.createDataFrame([(1, "abc", "zz"), (2, "abc", "aa"), (3, "abc", "mm")], "doc_id long, text string, lang string")
    row = predict(docs.limit(1), train(docs)).first()
    assert row.lang_pred == "aa" and abs(row.score - 1 / 3) < 1e-9


def test_too_many_labels_are_refused(spark):
    rows = [(i, "word text", f"dirty {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(train(docs, most_languages=30).languages) == 30
    with pytest.raises(ValueError, match="labels"):
        train(docs, most_languages=29)


def test_columns_of_any_name_play_no_part(spark):
    docs = spark.createDataFrame([(1, "abc", "zz", "x", 7.0)], "doc_id long, text string, lang string, lang_pred string, score double")
    row = predict(docs, train(docs)).first()
    assert (row.lang_pred, row.score) == ("zz", 1.0)
