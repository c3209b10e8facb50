"""Texts, passages and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.operators.pages import main_texts
from marlstone.operators.passages import shared_passages
from marlstone.plans.registry import query
from marlstone.sources.tables import load

_WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS words FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)
), doc_words AS (
    SELECT row_id, doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM docs
), doc_runs AS (
    SELECT row_id, doc_id, i, string_agg(w, ' ') OVER eight AS run, count(*) OVER eight AS n
    FROM doc_words WINDOW eight AS (PARTITION BY row_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), items AS (
    SELECT row_number() OVER () AS row_id, item_id, {_WORDS} AS words FROM benchmark
), item_words AS (
    SELECT row_id, item_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM items
), item_runs AS (
    SELECT DISTINCT item_id, i, run FROM (
        SELECT item_id, i, string_agg(w, ' ') OVER eight AS run, count(*) OVER eight AS n
        FROM item_words WINDOW eight AS (PARTITION BY row_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8
), met AS (
    SELECT d.row_id, d.doc_id, b.item_id, d.i AS doc_at, b.i AS item_at, d.i - b.i AS shift,
           d.i - row_number() OVER (PARTITION BY d.row_id, b.item_id, d.i - b.i ORDER BY d.i) AS island
    FROM doc_runs d JOIN item_runs b USING (run) WHERE d.n = 8
)
SELECT doc_id, item_id, CAST(min(doc_at) AS INTEGER) AS doc_start, CAST(min(item_at) AS INTEGER) AS item_start, count(*) + 7 AS length
FROM met GROUP BY row_id, doc_id, item_id, shift, island
""")
def passages_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of eight words and more that documents share with benchmark items: what contaminates a corpus."""
    docs, items = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark")
    return shared_passages(docs, items, "doc_id", "item_id")


@query()
def pages_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; tested against another parser, as SQL has none."""
    return main_texts(load(spark, sf_dir, "pages"), "page_id", "html")
