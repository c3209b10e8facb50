"""As-of, range and overlap joins without nested loops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.operators.running import HOT_ROWS, Running, _piece, running
from marlstone.sources.shared import staged

#: Pairs of rows that one tile of a dealt join compares at most, and tiles' worth of pairs in a task.
TILE_PAIRS = 1 << 22
TASK_TILES = 8


def _row_hash(df: DataFrame) -> Column:
    """A number to deal rows by: the same if a task runs again, and not the same for all copies of a row."""
    return F.xxhash64(*df.columns, F.spark_partition_id())


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: list[str],
    values: list[str],
    direction: str = "backward",
    strict: bool = False,
) -> DataFrame:
    """Every row of ``left`` with ``values`` of the nearest row of ``right`` in time.

    ``backward`` takes the latest right row not after the left row, ``forward`` the earliest not
    before it; ``strict`` leaves out rows of equal time. Rows meet within equal ``by`` columns. Both
    sides go into one scan by key and time, in which the last right row so far is carried along: no
    join, and hot keys are cut into pieces of time (see :func:`running`). Among right rows of equal
    time the last in order of ``values`` counts. Left rows without a match, or with a null time or
    key, get nulls.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    found = F.struct(*[F.col(c).alias(c) for c in values])
    lefts = left.select(
        *[F.col(c) for c in by],
        F.col(left_on).alias("_at"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
        F.lit(None).cast(right.select(found.alias("s")).schema["s"].dataType).alias("_right"),
    )
    rights = right.filter(F.col(right_on).isNotNull()).select(
        *[F.col(c) for c in by], F.col(right_on).alias("_at"), F.lit(None).cast(lefts.schema["_left"].dataType).alias("_left"), found.alias("_right")
    )
    both = lefts.unionByName(rights).withColumn("_is_left", F.col("_left").isNotNull().cast("int"))
    order = [("_at", direction == "backward"), ("_is_left", not strict), ("_right", True)]
    keyed = F.col("_at").isNotNull()
    for c in by:
        keyed = keyed & F.col(c).isNotNull()
    found = running(both.filter(keyed), by, order, {"_found": Running("last", "_right")}).filter("_is_left = 1")
    alone = both.filter(~keyed & (F.col("_is_left") == 1)).withColumn("_found", F.lit(None).cast(both.schema["_right"].dataType))
    return found.unionByName(alone).select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in values])


def range_join(
    points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, by: list[str] | None = None
) -> DataFrame:
    """Pairs of a point and a range that holds it: low <= point < high.

    Ranges are repeated for each bucket of ``width`` that they touch, so that an equi-join on the
    bucket (and ``by``) finds the pairs; no nested loop, and buckets of many pairs are dealt to many tasks
    (:func:`dealt_join`). Choose ``width`` near the usual length of a range. Columns of the two sides must differ, but for ``by``.
    """
    by = by or []
    bucket = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(width)))
    touched = ranges.filter(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    placed = points.withColumn("_bucket", bucket(point))
    pairs = dealt_join(placed, touched, [*by, "_bucket"])
    return pairs.filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bucket")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], bits: int = 2) -> DataFrame:
    """Pairs of a row of ``left`` and a row of ``right`` whose spans [low, high) of whole numbers overlap; no equi key needed.

    Cells of level n are 2 ** (``bits`` * n) long. A span lives at the lowest level whose cells are no
    shorter than itself, so it touches at most two of them, and of those of any level above. Rows
    meet by an equi-join on level and cell at the higher of their two levels: the row of the lower
    one is repeated for each level above that the other side has in use, so copies grow with the
    logarithm of the longest span, not with its length. Cells of many pairs are dealt to many tasks
    (:func:`dealt_join`). Of two cells that a pair shares the first
    reports it. Empty spans and those with a null end overlap nothing; a span must be shorter than
    2 ** 62. Columns of the two sides must differ.
    """
    top = 62 // bits

    def housed(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        low, high = (F.col(c).cast("long") for c in span)
        level = F.lit(top)
        for n in reversed(range(top)):
            level = F.when(high - low <= F.lit(1 << (bits * n)), n).otherwise(level)
        return df.filter(low < high).withColumns({f"_{side}_low": low, f"_{side}_last": high - 1, f"_{side}_level": level})

    def celled(df: DataFrame, side: str) -> DataFrame:
        first, last = (F.expr(f"shiftright(_{side}_{end}, {bits} * _level)") for end in ("low", "last"))
        return df.withColumn(f"_{side}_first", first).withColumn("_cell", F.explode(F.sequence(first, last)))

    def levels(df: DataFrame, side: str) -> list[int]:
        return sorted(r[0] for r in df.select(f"_{side}_level").distinct().collect())

    sides = {"l": housed(left, left_span, "l"), "r": housed(right, right_span, "r")}
    found = None
    for home, guest in (("r", "l"), ("l", "r")):
        # pairs of equal levels meet where the right side is at home
        least = f"_{guest}_level + {0 if guest == 'l' else 1}"
        above = F.expr(f"filter(array({', '.join(map(str, levels(sides[home], home)))}), n -> n >= {least})").cast("array<int>")
        guests = celled(sides[guest].withColumn("_level", F.explode(above)), guest)
        hosts = celled(sides[home].withColumn("_level", F.col(f"_{home}_level")), home)
        met = dealt_join(guests, hosts, ["_level", "_cell"]).filter(
            "_l_low <= _r_last AND _r_low <= _l_last AND _cell = greatest(_l_first, _r_first)"
        )
        met = met.select(*left.columns, *right.columns)
        found = met if found is None else found.unionByName(met)
    return found


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], tile_pairs: int = TILE_PAIRS) -> DataFrame:
    """Inner join in which tasks are dealt pairs, not rows: for keys that few rows share on either side, but whose pairs are many.

    Both sides are counted by key first. A key of more than ``tile_pairs`` pairs is cut into tiles, a
    part of the one side by a part of the other, near square, so that a row is repeated for pairs /
    sqrt(``tile_pairs``) at most. Tiles go to as many tasks as their pairs ask for, some
    ``TASK_TILES`` each, where Spark would settle the number by bytes. Rows whose key the other side
    lacks are dropped before. Columns of the two sides must differ, but for ``on``.
    """
    number = lambda df, into: df.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias(into))
    side, most = F.lit(float(math.isqrt(tile_pairs))), F.lit(float(tile_pairs))
    parts = lambda own, other: F.ceil(F.col(own) / F.greatest(side, most / F.col(other)))
    both = number(left, "_n_left").join(number(right, "_n_right"), on)
    sizes = staged(both.withColumns({"_of_left": parts("_n_left", "_n_right"), "_of_right": parts("_n_right", "_n_left")}), "pairs-by-key")
    pairs = sizes.agg(F.coalesce(F.sum(F.col("_n_left") * F.col("_n_right")), F.lit(0.0))).first()[0]
    if pairs <= TASK_TILES * tile_pairs:
        return left.join(right, on)
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(partitions, math.ceil(pairs / (TASK_TILES * tile_pairs)))

    def dealt(df: DataFrame, own: str, tiles: str) -> DataFrame:
        # small files are few tasks, too few for all that is repeated
        rows = df.withColumn("_row", _row_hash(df)).repartition(partitions, "_row")
        met = rows.join(sizes, on).withColumn("_own", F.expr(f"pmod(_row, {own})"))
        return met.withColumn("_tile", F.explode(F.expr(tiles))).select(*df.columns, "_tile").repartition(tasks, *on, "_tile")

    lefts = dealt(left, "_of_left", "transform(sequence(0L, _of_right - 1), n -> _own * _of_right + n)")
    rights = dealt(right, "_of_right", "transform(sequence(0L, _of_left - 1), n -> n * _of_right + _own)")
    # merged, since what is repeated may be far more than Spark takes it to be
    return lefts.hint("merge").join(rights, [*on, "_tile"]).drop("_tile")


def greater_join(left: DataFrame, right: DataFrame, by: list[str], left_value: str, right_value: str, cuts: int = 63) -> DataFrame:
    """Pairs of equal ``by`` in which ``left_value`` is greater than ``right_value``.

    Quantiles of both sides' values cut them into ``cuts`` + 1 stretches, and these are put together
    by twos, fours and so on. All right rows of lower stretches than a left row's pair with it; they are
    the whole of one block for each binary digit of its stretch. Only rows of one stretch are
    compared in vain, one in ``cuts`` + 1 of all pairs of evenly spread values. Nulls pair with
    nothing. Columns of the two sides must differ, but for ``by``.
    """
    left, right = left.filter(F.col(left_value).isNotNull()), right.filter(F.col(right_value).isNotNull())
    values = left.select(F.col(left_value).alias("v")).unionByName(right.select(F.col(right_value).alias("v")))
    found = values.agg(F.percentile_approx("v", [n / (cuts + 1) for n in range(1, cuts + 1)], 20 * cuts)).first()[0]
    at, digits = sorted(set(found or [])), cuts.bit_length()
    cells = "filter(transform(sequence(0, {0}), k -> struct(k AS _level, CAST({1} AS int) AS _block)), c -> {2})"
    lower = cells.format(digits - 1, "shiftright(_at, k) - 1", "shiftright(_at, c._level) % 2 = 1")
    held = cells.format(digits - 1, "shiftright(_at, k)", "c._block % 2 = 0")
    same = "array(struct(-1 AS _level, CAST(_at AS int) AS _block))"

    def placed(df: DataFrame, value: str, blocks: str) -> DataFrame:
        cut = df.withColumn("_at", _piece(F.col(value), at).cast("int"))
        return cut.withColumn("_cell", F.explode(F.expr(f"concat({same}, {blocks})"))).select(*df.columns, "_cell._level", "_cell._block")

    pairs = dealt_join(placed(left, left_value, lower), placed(right, right_value, held), [*by, "_level", "_block"])
    return pairs.filter(F.col(left_value) > F.col(right_value)).drop("_level", "_block")


def skew_join(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 16, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join in which a hot key of ``large`` is dealt to up to ``salts`` tasks, and rows of ``small`` of that key are repeated for each.

    Hot are keys of more rows than ``hot_rows`` and than 1 in 2 * the shuffle's partitions, so they
    are few; an aggregate by key goes first, to find them. All other rows of ``small`` stay single, so
    that it is as large as Spark takes it to be when it chooses a join. Rows of ``large`` with a null
    key match nothing and are dealt, too.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep rows of the large side can be salted")
    counts = large.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    fair = max(hot_rows, total // (2 * int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if largest <= fair:
        return large.join(small, on, how)
    pieces = F.least(F.ceil(F.col("_rows") / fair), F.lit(salts)).cast("int").alias("_salts")
    # fewer than 2 * partitions keys; null ones go without
    hot = F.broadcast(staged(counts.filter(F.col("_rows") > fair).dropna(subset=on).select(*on, pieces), "skewed-keys"))
    null_key = F.lit(False)
    for c in on:
        null_key = null_key | F.col(c).isNull()
    dealt = F.pmod(_row_hash(large), F.coalesce("_salts", F.when(null_key, salts), F.lit(1))).cast("int")
    salted = large.join(hot, on, "left").withColumn("_salt", dealt).select(*large.columns, "_salt")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    repeated = small.join(hot, on, "left").withColumn("_salt", every).select(*small.columns, "_salt")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def not_in(df: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """Rows whose ``column`` is not in ``others``, by SQL's rule for NOT IN: a null on either side hides rows.

    One plan: an ordinary anti-join, and one row that tells whether ``others`` is empty or holds nulls.
    """
    values = others.select(F.col(other).alias("_value"))
    told = values.agg(F.count(F.lit(1)).alias("_all"), F.count("_value").alias("_known"))
    left = df.join(values, F.col(column) == F.col("_value"), "left_anti").crossJoin(F.broadcast(told))
    return left.filter((F.col("_all") == 0) | ((F.col("_all") == F.col("_known")) & F.col(column).isNotNull())).drop("_all", "_known")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group; Spark keeps only ``k`` of a group in each task before the shuffle."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= k).withColumnRenamed("_nth", "nth")
