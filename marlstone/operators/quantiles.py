"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.running import HOT_ROWS, Running, running
from marlstone.sources.shared import staged


def exact_quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[float, bool]], pieces: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Quantiles of ``value`` for each group of ``by``: a column for each of ``wanted``, (share, whether to interpolate).

    Interpolated, the quantile lies between the two values around share * (n - 1); else it is the least
    value that a ``share`` of all don't exceed. Values are counted first, in tasks and then over all; a
    running sum over the distinct ones, in which hot groups are cut into pieces, tells where ranks
    lie. No task holds a group's values, as Spark's own exact percentile does. Nulls are left out;
    groups of nulls alone have null quantiles; a null key is a group.
    """
    counted = staged(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), "quantile-counts")
    known = counted.filter(F.col(value).isNotNull())
    totals = counted.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(
        F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col("_n"))), F.lit(0)).alias("_all")
    )
    ranked = running(known, by, [(value, True)], {"_upto": Running("sum", "_n")}, pieces, hot_rows)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
    rows = ranked.join(totals, same, "right")

    def at(rank: F.Column) -> F.Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col(value)))

    parts = []
    for name, (share, between) in wanted.items():
        place = F.lit(float(share)) * (F.col("_all") - 1)
        if between:
            parts += [at(F.floor(place)).alias(f"_low_{name}"), at(F.ceil(place)).alias(f"_high_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
        else:
            parts.append(at(F.greatest(F.ceil(F.lit(float(share)) * F.col("_all")) - 1, F.lit(0))).alias(name))
    found = rows.groupBy(*[f"_by{i}" for i in range(len(by))]).agg(*parts)
    out = []
    for name, (_, between) in wanted.items():
        low, high, part = (F.col(f"_{x}_{name}") for x in ("low", "high", "part"))
        out.append((low * (1 - part) + high * part).alias(name) if between else F.col(name))
    return found.select(*[F.col(f"_by{i}").alias(c) for i, c in enumerate(by)], *out)
