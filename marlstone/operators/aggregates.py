"""Aggregates with results that don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_sum(column: Column | str, scale: int = 2) -> Column:
    """Sum of doubles as decimals of ``scale`` digits: the same in any order of rows."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast(f"decimal(20, {scale})")).cast("double")


def exact_avg(column: Column | str, scale: int = 2) -> Column:
    """Mean by way of :func:`exact_sum`."""
    column = F.col(column) if isinstance(column, str) else column
    return exact_sum(column, scale) / F.count(column)


def two_stage(df: DataFrame, keys: list[str], partial: dict[str, Column], final: dict[str, Column], salts: int = 32) -> DataFrame:
    """Aggregate hot groups in two shuffles: by key and salt first, then by key.

    For aggregates that Spark can't combine before the shuffle, as distinct counts or lists.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    first = salted.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])
