"""Quality classifier: held-out accuracy, compiled rules against plain Python, statistics by hand, odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from marlstone.llm.quality import SHARES, STATISTICS, fit, held_out, measured, op13_quality, statistics


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op13_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert len(got) == len(docs) and all(got[r.doc_id].held_out == r.h for r in docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    poor = [r for r in labels if r.quality == 0]
    assert len(poor) > 5 and len(labels) > 80
    assert sum(got[r.doc_id].predicted == r.quality for r in labels) / len(labels) >= 0.95
    assert sum(got[r.doc_id].predicted == 0 for r in poor) / len(poor) >= 0.8


def measure(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r.s for r in df.select(statistics(F.col("text")).alias("s")).collect()]


def test_statistics(spark):
    a, b, c, d, e = measure(spark, ["AB cd cd cd!! $$", None, "", "x" * 400_000, "l|m\nl|m\n"])
    assert a.capitals == 2 / 16 and a.shouts == 2 / 16 and a.symbols == 2 / 16 and a.doubled == 4 / 16
    assert a.capital_words == 2 / 16 and a.repeated_words == 2 / 16 and a.word_length == 16 / 5 and a.not_letters == 8 / 16
    assert b == c and all(b[k] == 0 for k in (*SHARES, "log_chars", "word_length"))
    assert d.long_words == 1 and d.word_length == 400_000 and d.log_chars == pytest.approx(math.log1p(400_000))
    assert e.bars == 2 / 8 and e.repeated_lines == 3 / 8 and e.short_lines == 6 / 8 and e.breaks == 2 / 8


def test_compiled_rules_equal_plain_python(spark, small):
    docs, name = measured(spark.read.parquet(f"{small}/documents.parquet"))
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = fit(docs.join(labels, "doc_id").select(f"{name}.*", "label"))
    assert model.rules and all(len({(n, low) for n, low, _ in r.conditions}) == len(r.conditions) <= 6 for r in model.rules)
    for row in docs.select(F.col(name).alias("s"), model.score(F.col(name)).alias("score")).collect():
        odds = model.intercept
        for rule, weight in zip(model.rules, model.weights, strict=True):
            odds += weight * all(row.s[n] <= t if low else row.s[n] > t for n, low, t in rule.conditions)
        assert row.score == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-9)
    plan = docs.select(model.score(F.col(name)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark):
    rows = [(i % 40, "fine words here, " * (1 + i % 5), "s", 1) for i in range(60)] + [(100 + i, "$$$ ### " * (1 + i % 4), "s", 0) for i in range(30)]
    rows += [(None, None, None, None), (None, "", "s", 7), (200, "fine words, " * 30_000, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, statistics int")
    docs, name = measured(df)
    assert name != "statistics" and set(docs.columns) == {"doc_id", "a.b", "statistics", name} and docs.count() == len(rows)
    model = fit(docs.select(f"{name}.*", F.col("statistics").alias("label")))
    got = docs.select("statistics", model.score(F.col(name)).alias("score")).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == bool(r.statistics) for r in got if r.statistics in (0, 1))


def test_one_label_or_none(spark):
    docs, name = measured(spark.createDataFrame([("a b", 1), ("c", 1)], "text string, label int"))
    flat = docs.select(f"{name}.*", "label")
    score = lambda m: docs.select(m.score(F.col(name)).alias("s")).first().s
    assert score(fit(flat)) == pytest.approx(0.75)
    assert score(fit(flat.limit(0))) == pytest.approx(0.5)
    empty, name = measured(docs.limit(0).select(F.lit("x").alias("text")))
    assert empty.count() == 0 and set(STATISTICS) == set(empty.select(f"{name}.*").columns)
