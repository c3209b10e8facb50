"""Mixing sources to target weights: temperature, budgets and block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import sized, staged, table

#: Exponents are multiples of 1 / GRID.
GRID = 1024
#: How often a source is repeated at most if only its evenness is asked for.
MOST_REPEATS = 16.0


def bisect_exponent(holds: Callable[[float], bool], lowest: bool) -> float:
    """The lowest (or highest) exponent of the grid from 0 to 1 at which ``holds``, which is monotone.

    If it holds nowhere: 1 for the lowest, 0 for the highest.
    """
    low, high = 0, GRID
    while low < high:
        if lowest:
            middle = (low + high) // 2
            low, high = (low, middle) if holds(middle / GRID) else (middle + 1, high)
        else:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if holds(middle / GRID) else (low, middle - 1)
    return low / GRID


def source_weights(
    sources: DataFrame, evenness: float | None = None, max_repeats: float | None = None, whole: bool = False
) -> tuple[DataFrame, float]:
    """Weights of sources (source, tokens): shares of tokens to the power of an exponent, normalised.

    The exponent is bisected between 0 (even) and 1 (as found): the highest at which the entropy of
    the weights is at least ``evenness`` times that of even weights, or the lowest at which no
    source is repeated more than ``max_repeats`` times; given both, the higher of the two, as the
    limit binds. Repeats are those of a budget of all tokens or, if ``whole``, of the least budget in
    which every source occurs whole. Each trial is one aggregate over the sources, which stay in
    Spark. Sources without tokens have no weight.
    """
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    own = sources.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))

    def entropy_is_enough(exponent: float) -> bool:
        raised = F.pow("share", F.lit(exponent))
        z, dot, n = own.agg(F.sum(raised), F.sum(raised * F.ln("share")), F.count(F.lit(1))).first()
        if not n:
            return True
        return math.log(z) - exponent * dot / z >= evenness * math.log(n)

    def repeats_are_few(exponent: float) -> bool:
        raised = F.pow("share", F.lit(exponent))
        repeats = raised / F.col("share")
        z, most, least = own.agg(F.sum(raised), F.max(repeats), F.min(repeats)).first()
        return z is None or most / (least if whole else z) <= max_repeats

    if evenness is None and max_repeats is None:
        raise ValueError("give evenness or max_repeats")
    even = 0.0 if evenness is None else bisect_exponent(entropy_is_enough, False)
    exponent = even if max_repeats is None else max(even, bisect_exponent(repeats_are_few, True))
    z = own.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0]
    weighted = own.withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(z or 1.0)).select("source", "weight")
    return weighted, exponent


def _digest(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def text_digest(text: Column) -> Column:
    """MD5 of a text, null as empty: what tells documents of one id, or of none, apart."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def mix_sources(
    docs: DataFrame,
    evenness: float | None = None,
    max_repeats: float | None = None,
    whole: bool = False,
    budget: int | None = None,
    block_docs: int = 1024,
    seed: str = "mix",
    tokens: Column | None = None,
) -> DataFrame:
    """Choose documents so that their sources have the weights of :func:`source_weights`.

    ``budget`` tokens (all tokens by default; if ``whole``, the least with which every source occurs
    whole) are divided by weight. Each source's documents are dealt by hash into blocks of about
    ``block_docs``. An epoch takes the blocks in an order of its own, and the documents of a block
    likewise; a source's budget is filled with whole epochs and part of a last one, which ends with
    the document that reaches the budget. ``tokens`` counts a document's tokens, by default words.

    Returns one row per chosen document and epoch: doc_id, text_md5, source, epoch, block, block_rank,
    place (in the block), tokens, first_token (place in the source's stream). With ``evenness`` alone
    sources are repeated up to MOST_REPEATS times, so that a tiny one beside a huge one makes a bounded
    number of rows. Null sources count as the empty name, null texts have no tokens; a text of any
    length is one document; rows equal in doc_id and text count once, under their first source, and
    rows of one doc_id and different texts are different documents, as are those without doc_id. Equal
    digests are ordered by doc_id and text. Columns of other names play no part. An empty table gives
    no rows.
    """
    if max_repeats is None:
        max_repeats = MOST_REPEATS
    counted = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) if tokens is None else tokens
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            text_digest(F.col("text")).alias("text_md5"),
            F.coalesce("source", F.lit("")).alias("source"),
            counted.cast("long").alias("tokens"),
        )
        .groupBy("doc_id", "text_md5")
        .agg(F.min(F.struct("source", "tokens")).alias("one"))
        .select("doc_id", "text_md5", "one.source", "one.tokens", F.coalesce(F.col("doc_id").cast("string"), "text_md5").alias("name")),
        "mix-rows",
    )
    sources = staged(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    weights, _ = source_weights(sources, evenness, max_repeats, whole)
    weighted = sources.join(weights, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    if budget is None:
        need = F.max(F.col("tokens") / F.col("weight")) if whole else F.sum("tokens").cast("double")
        budget = weighted.filter("weight > 0").agg(need).first()[0] or 0.0
    least = F.col("tokens") if whole else F.lit(0).cast("long")
    planned = (
        weighted.withColumn("budget", F.greatest(least, F.floor(F.col("weight") * F.lit(float(budget)) + 0.5).cast("long")))
        .withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1 if whole else 0))
        .select(
            "source",
            F.col("tokens").alias("source_tokens"),
            F.col("full").cast("long").alias("full"),
            (F.col("budget") - F.col("full") * F.col("tokens")).alias("rest"),
            F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(block_docs))).cast("long").alias("blocks"),
        )
    )
    epochs = F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1))
    dealt = (
        rows.join(sized(staged(planned, "mix-plan")), "source")
        .filter("full > 0 OR rest > 0")
        .withColumn("block", F.pmod(_number(_digest(seed, F.col("name"))), F.col("blocks")))
    )
    sums = (
        dealt.groupBy("source", "block", "source_tokens", "full", "rest")
        .agg(F.sum("tokens").alias("block_tokens"))
        .withColumn("epoch", F.explode(epochs))
        .withColumn("order", _digest(seed, F.col("source"), F.col("epoch"), F.col("block")))
    )
    # a prefix scan in two steps, so that no task holds all blocks of a source: stretches of the order, then blocks
    sums = staged(sums.withColumn("stretch", F.substring("order", 1, 2)), "mix-blocks")
    stretches = W.partitionBy("source", "epoch").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        sums.groupBy("source", "epoch", "stretch")
        .agg(F.sum("block_tokens").alias("stretch_tokens"), F.count(F.lit(1)).alias("stretch_blocks"))
        .select(
            "source",
            "epoch",
            "stretch",
            F.coalesce(F.sum("stretch_tokens").over(stretches), F.lit(0)).alias("base_tokens"),
            F.coalesce(F.sum("stretch_blocks").over(stretches), F.lit(0)).alias("base_blocks"),
        )
    )
    by_epoch = W.partitionBy("source", "epoch", "stretch").orderBy("order", "block")
    ranked = (
        sums.join(bases, ["source", "epoch", "stretch"])
        .withColumn("block_rank", F.col("base_blocks") + F.row_number().over(by_epoch) - 1)
        .withColumn("before", F.col("base_tokens") + F.sum("block_tokens").over(by_epoch) - F.col("block_tokens"))
        .withColumn("limit", F.when(F.col("epoch") == F.col("full"), F.col("rest")).otherwise(F.col("source_tokens")))
        .withColumn("whole_block", F.col("epoch") < F.col("full"))
        .filter("whole_block OR before < limit")
        .select("source", "block", "epoch", "block_rank", "before", "limit", "whole_block")
    )
    placed = (
        dealt.select("doc_id", "text_md5", "name", "source", "tokens", "block", "source_tokens")
        .join(ranked, ["source", "block"])
        .withColumn("order", _digest(seed, F.col("epoch"), F.col("name")))
    )
    by_block = W.partitionBy("source", "block", "epoch").orderBy("order", F.asc_nulls_last("doc_id"), "text_md5")
    return (
        placed.withColumn("place", F.row_number().over(by_block) - 1)
        .withColumn("reached", F.col("before") + F.sum("tokens").over(by_block) - F.col("tokens"))
        .filter("whole_block OR reached < limit")
        .select(
            "doc_id",
            "text_md5",
            "source",
            "epoch",
            "block",
            F.col("block_rank").cast("long").alias("block_rank"),
            F.col("place").cast("long").alias("place"),
            "tokens",
            (F.col("epoch") * F.col("source_tokens") + F.col("reached")).alias("first_token"),
        )
    )


#: Evenness of the mix that the query makes.
QUERY_EVENNESS = 0.95


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix the sources of ``documents`` to 95 % of the highest entropy, each at most 16 times, within a budget of all tokens."""
    return mix_sources(table(spark, sf_dir, "documents"), evenness=QUERY_EVENNESS)


OP5_SQL = f"""
WITH docs AS (
    SELECT doc_id, md5(coalesce(text, '')) AS text_md5, min(coalesce(source, '')) AS source,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
    FROM documents GROUP BY doc_id, coalesce(text, '')
), named AS (
    SELECT *, coalesce(CAST(doc_id AS VARCHAR), text_md5) AS name FROM docs
), sources AS (
    SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS docs FROM docs GROUP BY source
), own AS (
    SELECT source, tokens, docs, tokens / (SELECT CAST(sum(tokens) AS DOUBLE) FROM sources) AS share
    FROM sources WHERE tokens > 0
), trials AS (
    SELECT k, ln(z) - k / {GRID}.0::DOUBLE * dot / z AS entropy, most / z AS repeats
    FROM (SELECT k, sum(pow(share, k / {GRID}.0::DOUBLE)) AS z, sum(pow(share, k / {GRID}.0::DOUBLE) * ln(share)) AS dot,
                 max(pow(share, k / {GRID}.0::DOUBLE) / share) AS most
          FROM own, range({GRID} + 1) AS t(k) GROUP BY k)
), best AS (
    SELECT greatest((SELECT coalesce(max(k), 0) FROM trials WHERE entropy >= {QUERY_EVENNESS}::DOUBLE * ln((SELECT count(*) FROM own))),
                    (SELECT coalesce(min(k), {GRID}) FROM trials WHERE repeats <= {MOST_REPEATS}::DOUBLE)) / {GRID}.0::DOUBLE AS exponent
), budgets AS (
    SELECT source, tokens AS source_tokens, greatest(1, CAST(ceil(docs / 1024.0) AS BIGINT)) AS blocks,
           CAST(floor(pow(share, exponent) / (SELECT sum(pow(share, exponent)) FROM own, best)
                      * (SELECT CAST(sum(tokens) AS DOUBLE) FROM own) + 0.5) AS BIGINT) AS budget
    FROM own, best
), planned AS (
    SELECT *, budget // source_tokens AS n_full, budget % source_tokens AS rest FROM budgets
), dealt AS (
    SELECT d.doc_id, d.text_md5, d.name, d.source, d.tokens, p.* EXCLUDE (source),
           CAST('0x' || substr(md5('mix:' || d.name), 1, 8) AS BIGINT) % p.blocks AS block
    FROM named d JOIN planned p USING (source)
), sums AS (
    SELECT source, block, source_tokens, n_full, rest, sum(tokens) AS block_tokens FROM dealt GROUP BY ALL
), epochs AS (
    SELECT *, unnest(range(CASE WHEN rest > 0 THEN n_full + 1 ELSE n_full END)) AS epoch FROM sums
), ranked AS (
    SELECT *, row_number() OVER o - 1 AS block_rank, sum(block_tokens) OVER o - block_tokens AS before
    FROM epochs
    WINDOW o AS (PARTITION BY source, epoch ORDER BY md5('mix:' || source || ':' || epoch || ':' || block), block
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), placed AS (
    SELECT d.doc_id, d.text_md5, d.source, r.epoch, d.block, r.block_rank, row_number() OVER o - 1 AS place, d.tokens,
           r.before + sum(d.tokens) OVER o - d.tokens AS reached, d.source_tokens, d.n_full, d.rest
    FROM dealt d JOIN ranked r ON d.source = r.source AND d.block = r.block
    WINDOW o AS (PARTITION BY d.source, d.block, r.epoch ORDER BY md5('mix:' || r.epoch || ':' || d.name), d.doc_id, d.text_md5
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT doc_id, text_md5, source, epoch, block, CAST(block_rank AS BIGINT) AS block_rank,
       CAST(place AS BIGINT) AS place, tokens, CAST(epoch * source_tokens + reached AS BIGINT) AS first_token
FROM placed WHERE epoch < n_full OR reached < rest
"""
