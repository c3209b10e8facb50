"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, table

#: Characters handled at once; longer texts go in overlapping stretches.
STRETCH = 250_000


def buckets_of(codes: np.ndarray, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """Hash buckets of the n-grams that start at each place of ``codes``, one array per size."""
    out = []
    for n in sizes:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        value = np.full(count, n, dtype=np.uint64)
        for i in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + count]
            value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((value >> np.uint64(64 - bits)).astype(np.int64))
    return out


def _codes(text: str) -> np.ndarray:
    """Lower-cased text as code points, framed by spaces."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of buckets (rows) for each language (columns), and those of languages."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    sizes: tuple[int, ...]
    bits: int

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        """Joint log-likelihood of each text (rows) with each language (columns)."""
        out = np.tile(self.log_prior, (len(texts), 1))
        held: list[np.ndarray] = []
        owners: list[int] = []
        total = 0
        for i, text in enumerate(texts):
            codes = _codes(text)
            if len(codes) > STRETCH:
                self._add(out, [codes], [i])
                continue
            held.append(codes)
            owners.append(i)
            total += len(codes)
            if total >= STRETCH:
                self._add(out, held, owners)
                held, owners, total = [], [], 0
        if held:
            self._add(out, held, owners)
        return out

    def _add(self, out: np.ndarray, codes: list[np.ndarray], owners: list[int]) -> None:
        """Add what the n-grams of these texts contribute, never across texts."""
        flat = np.concatenate(codes) if len(codes) > 1 else codes[0]
        ends = np.cumsum([len(c) for c in codes])
        starts = ends - [len(c) for c in codes]
        for n in self.sizes:
            for at in range(0, len(flat), STRETCH):
                part = flat[at : at + STRETCH + n - 1]
                found = buckets_of(part, (n,), self.bits)
                if not found:
                    continue
                scores = self.log_prob[found[0]]
                # an n-gram belongs to the text in which it starts, if it ends there too
                first = np.clip(starts - at, 0, len(scores))
                last = np.clip(ends - n + 1 - at, 0, len(scores))
                sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
                whole = np.maximum(last, first)
                out[owners] += sums[whole] - sums[first]


def train(
    docs: DataFrame,
    label: str = "lang",
    sizes: tuple[int, ...] = (1, 2, 3),
    bits: int = 16,
    docs_a_language: int = 2_000,
    smoothing: float = 0.1,
    most_languages: int = 256,
) -> LanguageModel:
    """Fit the model on rows of (doc_id, text, ``label``).

    Of each language about ``docs_a_language`` documents are used, whole, chosen by a hash of the
    doc_id; languages with fewer give all. Every label is learnt; more than ``most_languages`` are an
    error, as the model would outgrow the driver, which gets one count for each label and bucket.
    Rows without text or label teach nothing; without any such row the model knows no language.
    Texts of any length are learnt whole. Repeated rows count as often as they occur, and columns of
    other names play no part.
    """
    labelled = bounded_batches(docs).select("doc_id", "text", F.col(label).alias("lang")).filter("text is not null and lang is not null")
    known = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).limit(most_languages + 1)
    prior = {r.lang: r["docs"] for r in known.collect()}
    if len(prior) > most_languages:
        raise ValueError(f"more than {most_languages} labels in {label}: clean them, or raise most_languages")
    if not prior:
        return LanguageModel([], np.zeros(0), np.zeros((1 << bits, 0)), tuple(sizes), bits)
    shares = F.create_map(*[F.lit(x) for lang, n in prior.items() for x in (lang, min(1.0, docs_a_language / n))])
    point = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.filter(point < shares[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _sparse_counts(text, sizes, bits)
                if lang not in totals:
                    totals[lang] = np.zeros(1 << bits, dtype=np.int64)
                np.add.at(totals[lang], found[0], found[1])
        for lang, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.record_batch(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    counted = chosen.mapInArrow(count, "lang string, bucket int, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(prior)
    matrix = np.zeros((1 << bits, len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    matrix[summed["bucket"].to_numpy(dtype=np.int64), summed["lang"].map(column).to_numpy(dtype=np.int64)] = summed["n"]
    matrix += smoothing
    weights = np.array([prior[lang] for lang in languages], dtype=np.float64)
    return LanguageModel(languages, np.log(weights / weights.sum()), np.log(matrix / matrix.sum(axis=0)), tuple(sizes), bits)


def _sparse_counts(text: str, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    codes = _codes(text)
    found = [
        b
        for n in sizes
        for at in range(0, len(codes), STRETCH)
        for b in buckets_of(codes[at : at + STRETCH + n - 1], (n,), bits)
    ]
    return np.unique(np.concatenate(found), return_counts=True)


def predict(docs: DataFrame, model: LanguageModel, unknown: str = "und") -> DataFrame:
    """Language of every whole text: (doc_id, lang_pred, score), one row per input row.

    ``score`` is the posterior probability of the predicted language, from 0 to 1. Texts that are
    null or hold no letter are ``unknown`` with score 0, as is every text if the model knows no
    language. Ties go to the language that sorts first. Texts of any length are read whole, in
    stretches; repeated rows give repeated rows; null ids stay; an empty table stays empty; columns
    of other names play no part.
    """
    return predict_beside(docs.select("doc_id", "text"), model, "found", unknown).select("doc_id", "found.*")


def predict_beside(docs: DataFrame, model: LanguageModel, into: str, unknown: str = "und") -> DataFrame:
    """``docs`` with one more column ``into``, a struct of lang_pred and score; see :func:`predict`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        return _predict(texts, shared.value, unknown)

    return bounded_batches(docs).select("*", language(F.col("text")).alias(into))


def _predict(texts: pd.Series, model: LanguageModel, unknown: str) -> pd.DataFrame:
    preds, scores = np.full(len(texts), unknown, dtype=object), np.zeros(len(texts))
    values = texts.tolist()
    known = [i for i, t in enumerate(values) if t and any(map(str.isalpha, t))] if model.languages else []
    if known:
        joint = model.log_likelihoods([values[i] for i in known])
        best = joint.argmax(axis=1)
        top = joint[np.arange(len(known)), best]
        preds[known] = np.array(model.languages, dtype=object)[best]
        scores[known] = 1.0 / np.exp(joint - top[:, None]).sum(axis=1)
    return pd.DataFrame({"lang_pred": preds, "score": scores})


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every text of ``documents``; learn from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
