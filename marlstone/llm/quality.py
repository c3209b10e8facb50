"""Quality classifier: a sparse ensemble of rules from tree paths over text statistics, compiled to column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import private, quoted, staged, table

#: What a statistic counts: the share of a text's characters that its pattern matches.
SHARES = {
    "not_letters": r"[^\p{L}]+",
    "capitals": r"\p{Lu}+",
    "digits": r"[0-9]+",
    "blanks": r"\s+",
    "symbols": r"[^\p{L}\p{N}\s.,;:!?'\"()-]+",
    "shouts": r"[!?]+",
    "stops": r"[.,;:]+",
    "doubled": r"([^\p{L}\p{N}\s])\1+",
    "capital_words": r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})",
    "repeated_words": r"(?<!\S)(\S+)(?=\s+\1(?!\S))",
    "repeated_lines": r"(?m)^(.+)$(?=\n\1$)",
    "short_lines": r"(?m)^.{1,20}$",
    "long_words": r"\S{20,}",
    "bars": r"[|\t]+",
    "links": r"https?://\S+",
    "breaks": r"\n+",
}
STATISTICS = [*SHARES, "log_chars", "word_length"]


def statistics(text: Column) -> Column:
    """Statistics of a whole text as a struct of doubles; those of a null text are those of an empty one.

    All by expressions, each in memory proportional to the text.
    """
    body = F.coalesce(text, F.lit(""))
    chars = F.length(body)
    least_one = F.greatest(chars, F.lit(1))
    left = lambda pattern: F.length(F.regexp_replace(body, F.lit(pattern), F.lit("")))
    shares = [((chars - left(pattern)) / least_one).alias(name) for name, pattern in SHARES.items()]
    # every word becomes one character
    words = F.length(F.regexp_replace(F.ltrim(body), F.lit(r"\S+\s*"), F.lit("x")))
    return F.struct(*shares, F.log1p(chars.cast("double")).alias("log_chars"), (chars / F.greatest(words, F.lit(1))).alias("word_length"))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, whether at most, threshold) must hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, values: Column) -> Column:
        out = F.lit(True)
        for name, at_most, threshold in self.conditions:
            value = values[name]
            out = out & (value <= threshold if at_most else value > threshold)
        return out


@dataclass(frozen=True)
class RuleModel:
    """Log-odds as a sum of the weights of the rules that hold."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, values: Column) -> Column:
        """Probability of label 1 from a struct of :func:`statistics`, as one expression without Python."""
        odds = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            odds = odds + F.when(rule.holds(values), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-odds))


def _paths(node, names: list[str], taken: dict[tuple[str, bool], float]) -> list[Rule]:
    """Rules of all paths from the root that end below ``node``; a statistic's later threshold is the narrower."""
    if node.getClass().getSimpleName() != "InternalNode":
        return []
    split, out = node.split(), []
    name, threshold = names[split.featureIndex()], float(split.threshold())
    for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
        own = taken | {(name, at_most): threshold}
        out.append(Rule(tuple(sorted((n, low, t) for (n, low), t in own.items()))))
        out += _paths(child, names, own)
    return out


def fit(rows: DataFrame, label: str = "label", trees: int = 16, depth: int = 3, lasso: float = 0.002, seed: int = 11) -> RuleModel:
    """Fit a rule ensemble to rows of the ``STATISTICS`` and ``label`` (0 or 1), all of them, in Spark.

    Every path of a forest's trees from the root to a node is a rule, a conjunction of bounds of
    statistics. A logistic regression with lasso weights them; those of weight 0 are left out. Rows
    without a label teach nothing, repeated rows count as often as they occur. If a label has no
    row, the score is the smoothed share of label 1 for every text (0.5 without any row).
    """
    known = rows.filter(F.col(label).isin(0, 1)).select(
        F.array(*STATISTICS).alias("values"), F.struct(*STATISTICS).alias("named"), F.col(label).cast("double").alias("label")
    )
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        return RuleModel((), (), math.log((ones + 1) / (n - ones + 1)))
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=3, subsamplingRate=0.7, seed=seed
    ).fit(known.select(array_to_vector("values").alias("vector"), "label"))
    found = [rule for tree in forest.trees for rule in _paths(tree._java_obj.rootNode(), STATISTICS, {})]
    rules = sorted(set(found), key=lambda r: (len(r.conditions), r.conditions))
    if not rules:
        return RuleModel((), (), math.log((ones + 1) / (n - ones + 1)))
    held = F.array(*[rule.holds(F.col("named")).cast("double") for rule in rules])
    weighted = LogisticRegression(featuresCol="vector", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(
        known.select(array_to_vector(held).alias("vector"), "label")
    )
    kept = [(rule, float(w)) for rule, w in zip(rules, weighted.coefficients, strict=True) if w]
    return RuleModel(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(weighted.intercept))


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` without its ``text``, but with a struct of its :func:`statistics`, and that column's name.

    Written to the shared folder, so that the texts are read once for both fitting and scoring.
    """
    name, rest = private(docs, "statistics"), [quoted(c) for c in docs.columns if c != text]
    return staged(docs.select(*rest, statistics(F.col(quoted(text))).alias(name)), "quality"), name


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text of ``documents``; learn from the labels of those that are not held out."""
    docs, name = measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    model = fit(docs.join(labels, "doc_id").select(f"{name}.*", "label"))
    score = model.score(F.col(name))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
