"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def defined(c: Column) -> Column:
    """The number, null if it isn't finite."""
    return F.when(finite(c), c)


def month_ordinal(ts: Column) -> Column:
    """Months since year 0 of an epoch second, in the session's zone (UTC)."""
    at = F.timestamp_seconds(ts)
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def month_text(ordinal: Column) -> Column:
    """``YYYY-MM`` of a month ordinal."""
    year = F.floor(ordinal / 12).cast("int")
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad((ordinal - year * 12 + 1).cast("string"), 2, "0"))


def month_of_text(text: Column) -> Column:
    """Month ordinal of ``YYYY-MM``."""
    return (F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int") - 1).cast("int")


def day_text(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")


def fixed(c: Column, digits: int) -> Column:
    """A number for an artifact: rounded, null if undefined."""
    return F.round(defined(c), digits)


def capped_simplex(values: Column, floor: float, cap: float) -> Column:
    """The array nearest to ``values`` with sum 1 and each part in ``[floor, cap]``.

    The shift that makes the clipped parts add up to 1 is found by 100 halvings.
    """

    def clip(shift: Column) -> Column:
        return F.transform(values, lambda x: F.least(F.lit(cap), F.greatest(F.lit(floor), x - shift)))

    def total(shift: Column) -> Column:
        return F.aggregate(clip(shift), F.lit(0.0), lambda a, x: a + x)

    start = F.struct((F.array_min(values) - F.lit(cap)).alias("lo"), (F.array_max(values) - F.lit(floor)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        over = total(middle) > 1
        return F.struct(F.when(over, middle).otherwise(s["lo"]).alias("lo"), F.when(over, s["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, halve, lambda s: clip((s["lo"] + s["hi"]) / 2))
