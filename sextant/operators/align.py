"""Alignment of several series on common dates or months, and of a benchmark with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import period_returns


def align_on_dates(prices: DataFrame, key: str = "ts") -> DataFrame:
    """The points of ``prices`` at dates that all its series have; one count per date instead of a join per series.

    ``key`` is ``ts`` for equal epoch seconds or ``date`` for equal days.
    """
    on = F.col("ts") if key == "ts" else F.floor(F.col("ts") / 86_400)
    dated = prices.withColumn("__on", on)
    wanted = prices.agg(F.count_distinct("symbol").alias("__k"))
    full = dated.groupBy("__on").agg(F.count_distinct("symbol").alias("__n")).join(F.broadcast(wanted), F.col("__n") == F.col("__k"))
    return dated.join(full.select("__on"), "__on", "left_semi").drop("__on")


def aligned_returns(prices: DataFrame) -> DataFrame:
    """``(symbol, ts, px, ret)`` over the dates of ``prices``; a return spans the gap to the common date before."""
    return period_returns(prices).select("symbol", "ts", "px", "ret")


def forward_fill(rows: DataFrame, column: str, order: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Null ``column`` takes the last value before it; leading nulls stay."""
    spec = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(spec))


def rebase(rows: DataFrame, column: str, order: str = "ts", keys: Sequence[str] = (), base: float = 100.0) -> DataFrame:
    """``column`` over its first value that isn't null, times ``base``."""
    spec = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(column, F.try_divide(F.col(column), F.first(column, ignorenulls=True).over(spec)) * base)


def benchmark_on(dates: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(ts, value)``: the benchmark's price on each of ``dates(ts)``, filled forward and rebased to 100."""
    joined = dates.select("ts").join(benchmark.select("ts", F.col("px").alias("value")), "ts", "left")
    return rebase(forward_fill(joined, "value"), "value")


def time_slice(prices: DataFrame, start: int | None = None, end: int | None = None, least: int = 3) -> DataFrame:
    """Points from ``start`` to ``end``, both included; series left with fewer than ``least`` go."""
    cut = prices
    if start is not None:
        cut = cut.where(F.col("ts") >= start)
    if end is not None:
        cut = cut.where(F.col("ts") <= end)
    long = cut.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("symbol")
    return cut.join(long, "symbol", "left_semi")


def common_window(monthly: DataFrame) -> DataFrame:
    """One row ``(lo, hi)``: the months that every series reaches."""
    ends = monthly.groupBy("symbol").agg(F.min("month_idx").alias("i0"), F.max("month_idx").alias("i1"))
    return ends.agg(F.max("i0").alias("lo"), F.min("i1").alias("hi"))


def align_on_months(monthly: DataFrame, window: DataFrame | None = None, least_months: int = 6, least_series: int = 2) -> DataFrame:
    """``(symbol, month_idx, px)`` inside the one-row ``window(lo, hi)`` for the series that cover all of it.

    Nothing is left if the window has under ``least_months`` or under ``least_series`` cover it.
    """
    window = window if window is not None else common_window(monthly)
    ends = monthly.groupBy("symbol").agg(F.min("month_idx").alias("i0"), F.max("month_idx").alias("i1"))
    covers = (F.col("i0") <= F.col("lo")) & (F.col("i1") >= F.col("hi")) & (F.col("hi") - F.col("lo") + 1 >= least_months)
    covering = ends.join(F.broadcast(window), covers).select("symbol", "lo", "hi")
    enough = covering.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_series)
    covering = covering.join(F.broadcast(enough.select(F.lit(1).alias("one"))), F.lit(True), "left_semi")
    inside = monthly.join(covering, "symbol").where(F.col("month_idx").between(F.col("lo"), F.col("hi")))
    return inside.select("symbol", "month_idx", "px")
