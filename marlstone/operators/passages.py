"""Passages that texts share with given ones: rare words first, then word by word in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.sources.shared import staged

#: What stands between words: ASCII but for letters and digits.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of a list that travels to all tasks; a longer one is shuffled.
MOST_SENT = 500_000


def words_of(text: Column) -> Column:
    """Words of a text in lower case; none of a null one."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def shared_passages(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", words: int = 8) -> DataFrame:
    """Longest runs of ``words`` words or more that a text of ``docs`` has in common with one of ``items``.

    One row for each run: ``doc_id``, ``item_id``, doc_start, item_start (words before it) and length
    (in words). A run can't be prolonged on either side; where passages repeat, each pair of places
    is a run of its own.

    Every run of ``words`` words of an item is known by its rarest word, by the number of texts of
    ``docs`` that hold it. One pass over ``docs`` counts those, another looks for the rarest words
    only, so hardly any place of a text is looked at further; the words around the places found are
    then compared, and neighbours joined to runs. No text is shuffled unless too many hold such
    words to send their list to all tasks. Rows equal in id and text count once, others of a
    repeated or null id are texts of their own; null and empty texts share nothing; texts of any
    length are searched whole. Columns of other names play no part.
    """
    asked = items.select(F.col(item_id).alias("_item"), words_of(F.col(text)).alias("_words")).filter(F.size("_words") >= words)
    every = F.transform(F.sequence(F.lit(1), F.size("_words") - words + 1), lambda i: F.slice("_words", i, words))
    runs = staged(asked.select("_item", F.posexplode(every).alias("_item_start", "_run")).distinct(), "passages-runs")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("_doc"), F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), body).cast("binary")).alias("_key"), body.alias("_text"))
    spread = keyed.select("_key", F.posexplode(words_of(F.col("_text"))).alias("_at", "_word"))
    wanted = staged(runs.select(F.explode("_run").alias("_word")).distinct(), "passages-words")
    held = spread.join(_sent(wanted), "_word").groupBy("_word").agg(F.approx_count_distinct("_key").alias("_texts"))
    placed = runs.select("*", F.posexplode("_run").alias("_offset", "_word")).join(held, "_word")
    rarest = F.min(F.struct("_texts", "_offset", "_word")).alias("_rarest")
    known = placed.groupBy("_item", "_item_start", "_run").agg(F.count(F.lit(1)).alias("_known"), rarest)
    # a run of which a word is in no text is nowhere
    anchors = known.filter(F.col("_known") == words).select("_item", "_item_start", "_run", "_rarest._word", "_rarest._offset")
    anchors = staged(anchors, "passages-anchors")
    rare = _sent(staged(anchors.select("_word").distinct(), "passages-rare"))
    places = spread.join(rare, "_word").groupBy("_key").agg(F.collect_set(F.struct("_at", "_word")).alias("_places"))
    places = _sent(staged(places, "passages-places"))
    around = keyed.join(places, "_key").select("_doc", "_key", "_text", "_places").withColumn("_words", words_of(F.col("_text")))
    around = around.select("_doc", "_key", "_words", F.inline("_places"))
    around = around.join(_sent(anchors), "_word").filter("_at >= _offset")
    start = F.col("_at") - F.col("_offset")
    met = around.filter(F.slice("_words", start + 1, words) == F.col("_run"))
    met = met.select("_doc", "_key", "_item", start.alias("_start"), "_item_start").distinct()
    # neighbours in both texts are of one run
    side = W.partitionBy("_key", "_doc", "_item", F.col("_start") - F.col("_item_start")).orderBy("_start")
    met = met.withColumn("_run", F.col("_start") - F.row_number().over(side))
    joined = met.groupBy("_key", "_doc", "_item", "_run", (F.col("_start") - F.col("_item_start")).alias("_shift")).agg(
        F.min("_start").alias("doc_start"), F.min("_item_start").alias("item_start"), (F.count(F.lit(1)) + words - 1).alias("length")
    )
    return joined.select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), "doc_start", "item_start", "length")
