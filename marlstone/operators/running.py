"""Running values in order of time, for keys of any size: hot keys are cut into pieces of time and scanned by prefix."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.sources.shared import staged

#: Keys of fewer rows stay whole, whatever their share.
HOT_ROWS = 10_000
#: Cuts that one expression compares with; a tree of more would outgrow generated code.
MOST_COMPARED = 256


@dataclass(frozen=True)
class Running:
    """One value of the rows up to each: the last that is not null, or their sum, count, min or max.

    ``strict`` leaves out the row itself. Nulls are skipped; without any other value the result is
    null, for ``count`` 0.
    """

    kind: str
    column: str
    strict: bool = False

    def over(self, window: W) -> Column:
        frame = window.rowsBetween(W.unboundedPreceding, -1 if self.strict else W.currentRow)
        return (F.last(self.column, ignorenulls=True) if self.kind == "last" else getattr(F, self.kind)(self.column)).over(frame)

    def joined(self, own: Column, before: Column) -> Column:
        """The value of a piece's rows so far, joined to that of all pieces before."""
        if self.kind == "last":
            return F.coalesce(own, before)
        if self.kind in ("min", "max"):
            return (F.least if self.kind == "min" else F.greatest)(own, before)
        return F.coalesce(own + before, own, before)

    def __post_init__(self) -> None:
        if self.kind not in ("last", "sum", "count", "min", "max"):
            raise ValueError(f"no running {self.kind}")


def _ordered(order: Sequence[tuple[str, bool]], backwards: bool = False) -> list[Column]:
    """Columns to order by; nulls first in either direction, last if ``backwards``."""
    if backwards:
        return [F.desc_nulls_last(c) if up else F.asc_nulls_last(c) for c, up in order]
    return [F.asc_nulls_first(c) if up else F.desc_nulls_first(c) for c, up in order]


def _tree(value: Column, cuts: list, first: int = 0) -> Column:
    """How many of the ascending ``cuts`` are below ``value``, by a decision tree of comparisons; none for null."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    above = _tree(value, cuts[middle + 1 :], first + middle + 1)
    return F.when(value > F.lit(cuts[middle]), above).otherwise(_tree(value, cuts[:middle], first))


def _piece(value: Column, cuts: list) -> Column:
    """As :func:`_tree`, for any number of ``cuts``: beyond ``MOST_COMPARED`` a tree of every n-th, then those in between."""
    if len(cuts) <= MOST_COMPARED:
        return _tree(value, cuts)
    step = math.isqrt(len(cuts)) + 1
    stretches = F.array(*[F.array(*[F.lit(c) for c in cuts[at : at + step - 1]]) for at in range(0, len(cuts) + 1, step) if cuts[at : at + step - 1]])
    coarse = _tree(value, cuts[step - 1 :: step])
    between = F.coalesce(F.size(F.filter(F.get(stretches, coarse), lambda cut: cut < value)), F.lit(0))
    return coarse * step + F.when(value.isNotNull(), F.greatest(between, F.lit(0))).otherwise(0)


def running(
    df: DataFrame,
    by: list[str],
    order: Sequence[tuple[str, bool]],
    values: dict[str, Running],
    pieces: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``df`` with a column for each of ``values``, over the rows of equal ``by`` in ``order`` (column, ascending).

    Keys that hold more than a fair share of the rows, 1 in 2 * ``pieces`` (by default the shuffle's
    partitions), and more than ``hot_rows``, are cut at quantiles of the first column of ``order``, so
    that a key which holds a third of all rows is spread over a third of the tasks. Each piece is
    scanned by itself; the values of whole pieces, a table of at most 2 * ``pieces`` keys times
    ``pieces``, go through a scan of their own and are added to the rows of the pieces after. Other
    keys go through one window. Rows of one time stay together, so what equals in the first column
    of ``order`` must fit a task. A null key is a key, a null time comes first. Rows that are
    equal in all of ``order`` are taken in any order.
    """
    spark = df.sparkSession
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    window = W.partitionBy(*by).orderBy(*_ordered(order))
    plain = lambda rows: rows.withColumns({into: v.over(window) for into, v in values.items()})
    if not by:
        raise ValueError("give at least one key")
    names = [f"_key{i}" for i in range(len(by))]
    counts = df.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    fair = max(hot_rows, total // (2 * pieces))
    if largest <= fair:
        return plain(df)
    hot = staged(counts.filter(F.col("_rows") > fair).drop("_rows"), "running-hot")
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same = same & df[c].eqNullSafe(hot[n])
    # fewer than 2 * pieces keys
    many = df.join(F.broadcast(hot), same, "left_semi")
    time, up = order[0]
    shares = [k / pieces for k in range(1, pieces)]
    found = many.agg(F.percentile_approx(time, shares, 20 * pieces)).first()[0] if shares else []
    # a piece is known by its number in the order of the scan
    number = _piece(F.col(time), sorted(set(found or [])))
    many = many.withColumn("_piece", number if up else F.when(F.col(time).isNull(), F.lit(-pieces)).otherwise(-number))
    cell = W.partitionBy(*by, "_piece").orderBy(*_ordered(order))
    scanned = many.withColumns({into: v.over(cell) for into, v in values.items()})
    before = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    keys = [*by, "_piece"]
    ends = many.groupBy(*keys).agg(*[getattr(F, v.kind)(v.column).alias(into) for into, v in values.items() if v.kind != "last"], F.lit(1).alias("_one"))
    for into, v in values.items():
        if v.kind == "last":
            nth = F.row_number().over(W.partitionBy(*keys).orderBy(*_ordered(order, backwards=True)))
            last = many.filter(F.col(v.column).isNotNull()).withColumn("_nth", nth).filter("_nth = 1")
            last = last.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col(v.column).alias(into))
            equal = F.lit(True)
            for i, c in enumerate(keys):
                equal = equal & ends[c].eqNullSafe(last[f"_k{i}"])
            ends = ends.join(last, equal, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    sums = {into: (F.last(into, ignorenulls=True) if v.kind == "last" else getattr(F, "sum" if v.kind == "count" else v.kind)(into)) for into, v in values.items()}
    carried = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[x.over(before).alias(f"_before_{into}") for into, x in sums.items()])
    equal = F.lit(True)
    for i, c in enumerate(keys):
        equal = equal & scanned[c].eqNullSafe(carried[f"_k{i}"])
    met = scanned.join(carried, equal)
    done = met.select(*[scanned[c] for c in df.columns], *[v.joined(scanned[into], carried[f"_before_{into}"]).alias(into) for into, v in values.items()])
    return plain(df.join(F.broadcast(hot), same, "left_anti")).unionByName(done)
