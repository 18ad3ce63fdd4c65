"""Month-end series and their stored form, start month plus dense prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import month_of_text, month_ordinal, month_text


def month_end(prices: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last point of each month: ``(*keys, month_idx, ts, px)``."""
    return (
        prices.groupBy(*keys, month_ordinal(F.col("ts")).alias("month_idx"))
        .agg(F.max("ts").alias("ts"), F.max_by("px", "ts").alias("px"))
        .select(*keys, "month_idx", "ts", "px")
    )


def to_segments(monthly: DataFrame, keys: Sequence[str] = ("symbol",), digits: int | None = 4) -> DataFrame:
    """``(*keys, start_month, p)`` of ``(*keys, month_idx, px)``; a series' months are in its own array only."""
    value = F.round("px", digits) if digits is not None else F.col("px")
    points = F.array_sort(F.collect_list(F.struct(F.col("month_idx").alias("m"), value.alias("v"))))
    packed = monthly.groupBy(*keys).agg(points.alias("points"))
    return packed.select(*keys, month_text(F.col("points")[0]["m"]).alias("start_month"), F.col("points.v").alias("p"))


def from_segments(segments: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``(*keys, month_idx, px)``; months count on from the start without a gap."""
    return segments.select(*keys, month_of_text(F.col("start_month")).alias("i0"), F.posexplode("p").alias("pos", "px")).select(
        *keys, (F.col("i0") + F.col("pos")).cast("int").alias("month_idx"), "px"
    )


def without_gaps(monthly: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The series whose months follow one another, as stored segments assume."""
    whole = monthly.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("month_idx") - F.min("month_idx") + 1).alias("span"))
    return monthly.join(whole.where("n = span").select(*keys), list(keys), "left_semi")
