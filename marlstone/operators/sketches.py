"""Sketches of a table by day, kept as a table and merged for any range of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_sketches(df: DataFrame, day: str, item: str, value: str) -> DataFrame:
    """One row for each ``day``: n, a theta sketch of the distinct ``item`` and a KLL sketch of ``value``, nulls left out.

    A few KB a day, whatever its rows; they are made in tasks and merged, so a hot day is no burden.
    """
    return df.groupBy(day).agg(
        F.count(F.lit(1)).alias("n"), F.theta_sketch_agg(F.col(item), 14).alias("items"), F.kll_sketch_agg_double(value, 400).alias("quantiles")
    )


def merged(sketches: DataFrame, *by: Column) -> DataFrame:
    """The sketches of several days as one, by any grouping of days: n, items, quantiles."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.theta_union_agg("items", 14).alias("items"), F.kll_merge_agg_double("quantiles").alias("quantiles")
    )


def _cell(item: Column, line: int, width: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(line), item), F.lit(width)).cast("int")


def count_min(df: DataFrame, by: list[str], item: str, width: int = 2048, lines: int = 5) -> DataFrame:
    """Count-min sketches of ``item`` for each group of ``by`` as rows (..., line, cell, n), cells of no rows left out.

    At most ``width`` * ``lines`` rows a group; sketches of groups are merged by adding up n. Null items
    are left out.
    """
    cells = F.array(*[F.struct(F.lit(line).alias("line"), _cell(F.col(item), line, width).alias("cell")) for line in range(lines)])
    spread = df.filter(F.col(item).isNotNull()).select(*by, F.explode(cells).alias("at"))
    return spread.groupBy(*by, "at.line", "at.cell").agg(F.count(F.lit(1)).alias("n"))


def estimated(sketch: DataFrame, asked: DataFrame, by: list[str], item: str, width: int = 2048, lines: int = 5) -> DataFrame:
    """``asked`` with ``estimate``, how often its ``item`` occurs in the sketch of its group ``by``: never less than the truth.

    It is above the truth by more than e / ``width`` of the group's rows in a share of e ** -``lines`` of
    the cases. ``sketch`` comes from :func:`count_min`, merged or not.
    """
    cells = F.array(*[F.struct(F.lit(line).alias("line"), _cell(F.col(item), line, width).alias("cell")) for line in range(lines)])
    rows = asked.select(*by, item).distinct().select(*by, item, F.explode(cells).alias("at")).select(*by, item, "at.*")
    # a cell that isn't there counts 0
    found = rows.join(sketch, [*by, "line", "cell"], "left").groupBy(*by, item)
    return asked.join(found.agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate")), [*by, item])
