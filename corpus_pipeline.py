"""A training corpus from raw documents: language, near-duplicates, secrets, mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import private, quoted, sized, staged, table
from marlstone.llm.language import predict_beside, train
from marlstone.llm.mixing import mix_sources, text_digest
from marlstone.llm.near_duplicates import near_duplicates
from marlstone.llm.packing import pack_documents
from marlstone.llm.secrets import find_secrets, redacted


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: no letters, or less than even odds for any language.

    The classifier learns from the labels of the documents themselves. Null and empty texts have no
    letters and go, whatever their label; texts are read whole, however long; each of repeated rows
    is judged alike; null ids and sources don't matter. Columns of any other name stay as they are.
    An empty table stays empty.
    """
    found = private(docs, "found")
    judged = predict_beside(docs, train(docs), found)
    return judged.filter(f"{found}.lang_pred != 'und' AND {found}.score >= 0.5").select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates: five-word shingles, similarity 0.8 or more.

    The document of the smallest doc_id stays. Rows of one doc_id and different texts are different
    documents; of rows equal in doc_id and text one stays. Rows without doc_id stay, as do null, empty
    and blank texts, but for repeated rows; texts are compared whole, however long. Columns of any
    other name stay as they are. An empty table stays empty.
    """
    found = staged(near_duplicates(docs).select("doc_id", "text_hash", "chosen"), "pipeline-near")
    own, text_hash, doc_id = private(docs, "own"), private(docs, "hash"), private(docs, "id")
    keyed = docs.withColumns({doc_id: F.col("doc_id").cast("long"), text_hash: F.xxhash64("text")})
    keys = (F.col(doc_id) == F.col("k.own_id")) & (F.col(text_hash) == F.col("k.own_hash"))
    renamed = [F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")]
    dropped = staged(found.filter("NOT chosen").select(*renamed).distinct(), "pipeline-dropped")
    left, columns = keyed.join(sized(dropped).alias("k"), keys, "left_anti"), [quoted(c) for c in docs.columns]
    repeated = found.filter("chosen AND doc_id IS NOT NULL").groupBy(*renamed).count().filter("count > 1").drop("count")
    repeated = staged(repeated, "pipeline-repeated")
    if repeated.isEmpty():
        return left.select(*columns)
    # Spark keeps one row of each key in every task before it shuffles them
    nth = F.row_number().over(W.partitionBy(doc_id, text_hash).orderBy(F.to_json(F.struct(*columns))))
    once = left.join(sized(repeated).alias("k"), keys, "left_semi").withColumn(own, nth).filter(F.col(own) == 1)
    return left.join(sized(repeated).alias("k"), keys, "left_anti").select(*columns).unionByName(once.select(*columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in the place of every secret; texts without secrets stay as they are, null ones null.

    A text of nothing but a secret becomes the mark; overlapping secrets share one; texts are searched
    whole, however long; no row is dropped or added, whatever its id, and repeated rows stay. n_chars
    follows the new text. Columns of any other name stay as they are. An empty table stays empty.
    """
    found, clean = private(docs, "found"), private(docs, "clean")
    spans = F.col(f"{found}.spans")
    marked = find_secrets(docs, into=found).withColumn(clean, redacted(F.col("text"), spans))
    length = F.when(F.size(spans) > 0, F.length(clean).cast("long")).otherwise(F.col("n_chars"))
    changed = {"text": F.col(clean), "n_chars": length}
    return marked.select(*[changed.get(c, F.col(quoted(c))).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of small sources, up to twice, so that no source outweighs the others as before.

    Every document occurs at least once; a chosen epoch of a document is a row of its own. Rows are
    written in the order of the mix: every source's stream of permuted blocks is laid evenly over the
    whole, so that sources alternate and the epochs of a document lie apart. Null sources are one
    source of their own; null and empty texts have no tokens and occur once; a very long text is one
    document; rows of one doc_id and different texts are different documents, rows equal in both are
    repeated alike, as are rows of equal text without doc_id. Columns of any other name stay as they
    are. An empty table stays empty.
    """
    chosen = mix_sources(docs, max_repeats=2.0, whole=True)
    own = [F.col(c).alias(f"own_{c}") for c in ("doc_id", "text_md5", "source")]
    chosen = staged(chosen.select(*own, "tokens", "first_token"), "pipeline-mix")
    ends = chosen.groupBy("own_source").agg(F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    places = staged(
        chosen.join(sized(staged(ends, "pipeline-ends")), "own_source").select(
            "own_doc_id", "own_text_md5", (F.col("first_token") / F.greatest("end", F.lit(1))).alias("own_place")
        ),
        "pipeline-places",
    )
    place, stretch, doc_id, text_md5 = (private(docs, c) for c in ("place", "stretch", "id", "md5"))
    # stretches of about a thousand documents; Spark deals them to tasks, which sort them
    stretches = max(1, places.count() // 1024)
    columns = [quoted(c) for c in docs.columns]
    keyed = docs.withColumns({doc_id: F.col("doc_id").cast("long"), text_md5: text_digest(F.col("text"))})
    same = (F.col(f"d.{text_md5}") == F.col("p.own_text_md5")) & F.col(f"d.{doc_id}").eqNullSafe(F.col("p.own_doc_id"))
    mixed = keyed.alias("d").join(sized(places).alias("p"), same).select(*[f"d.{c}" for c in columns], F.col("p.own_place").alias(place))
    mixed = mixed.withColumn(stretch, F.floor(F.col(place) * stretches))
    return mixed.repartition(stretch).sortWithinPartitions(stretch, place).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, balanced by attention cost; one row per piece.

    Null and empty texts are an end id alone; texts of any length are cut freely; repeated rows and
    rows without doc_id are packed row by row; other columns play no part. An empty table gives no rows.
    """
    return pack_documents(docs)


#: (name, function); each takes (spark, docs, sf_dir), and its result, written and read again, is the next one's docs.
STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Training, signatures, the bisection of a temperature and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
