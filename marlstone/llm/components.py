"""Connected components of a graph given as edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import new_path, remove, staged

#: Tasks among which the neighbours of one node are dealt.
SALTS = 16


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node of its neighbourhood.

    The neighbours of a node may be a third of all nodes, so they are dealt by salt, and the
    smallest one, a narrow row, is repeated for each salt.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["u", "salt"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    edges = edges.repartition("u")  # one shuffle for both the aggregate and the join
    least = _smallest(edges)
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 OR up = 1 AND down = 1").count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node of ``edges`` (columns a and b): (node, component), its smallest node.

    Alternates large-star and small-star steps until the edges form stars around the smallest
    nodes; their number never grows, and the rounds grow with the logarithm of the longest chain.
    Each round is a table of its own, and the one before is deleted. Loops and repeated edges are
    fine; edges with a null end are left out.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b"), F.greatest("a", "b")
    path = new_path(spark, "components")
    current = staged(edges.filter("a != b").select(high.alias("u"), low.alias("v")).distinct(), "components", path)
    while not _are_stars(current):
        earlier, path = path, new_path(spark, "components")
        current = staged(_small_star(_large_star(current)), "components", path)
        remove(spark, earlier)
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
