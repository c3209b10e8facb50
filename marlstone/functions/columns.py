"""Functions of columns that spell out what engines otherwise settle differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_week(ts: Column) -> Column:
    """Sunday 0 to Saturday 6."""
    return (F.dayofweek(ts) - 1).cast("int")


def truncated(unit: str, ts: Column) -> Column:
    """Start of the unit as a timestamp without time zone."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double; null where the denominator is zero."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def json_int(column: Column, path: str) -> Column:
    """Whole number at a path of a JSON text."""
    return F.get_json_object(column, path).cast("int")


def half_up(column: Column, digits: int = 0) -> Column:
    """Rounding by floor, the same wherever doubles are."""
    factor = F.lit(float(10**digits))
    return F.floor(column * factor + 0.5).cast("double") / factor
