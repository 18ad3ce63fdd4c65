"""Equity curves of weighted portfolios, rebalanced every period or held."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import benchmark_on
from .metrics import curve_metrics, series_metrics
from .resample import month_end
from .scan import running


def rebalanced(prices: DataFrame, weights: DataFrame, base: float = 100.0, width: int | None = None) -> DataFrame:
    """``(scheme, mode, ts, value)`` of portfolios set back to their weights at every date.

    ``prices`` are aligned. The curve starts at ``base`` and grows by the weighted
    mean of the members' returns, added up as logarithms. With a ``width`` in seconds,
    series and curve are cut into stretches of it, and no task holds a whole one.
    """
    before = running(prices, ("symbol",), "ts", {"__prev": ("before", F.col("px"))}, width)
    step = F.coalesce(F.try_divide(F.col("px"), F.col("__prev")) - 1, F.lit(0.0))
    moves = before.withColumn("ret", step).join(weights.select("scheme", "symbol", "weight"), "symbol")
    per_date = moves.groupBy("scheme", "ts").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    grown = running(per_date, ("scheme",), "ts", {"__log": ("sum", F.log1p("ret"))}, width)
    return grown.select("scheme", F.lit("rebal").alias("mode"), "ts", (F.lit(base) * F.exp("__log")).alias("value"))


def buy_and_hold(prices: DataFrame, weights: DataFrame, base: float = 100.0) -> DataFrame:
    """``(scheme, mode, ts, value)`` of portfolios bought at the first date and left alone."""
    whole = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grown = prices.withColumn("growth", F.try_divide(F.col("px"), F.first("px").over(whole)))
    held = grown.join(weights.select("scheme", "symbol", "weight"), "symbol")
    summed = held.groupBy("scheme", "ts").agg((F.sum(F.col("weight") * F.col("growth")) * base).alias("value"))
    return summed.select("scheme", F.lit("buyhold").alias("mode"), "ts", "value")


def equity_curves(prices: DataFrame, weights: DataFrame) -> DataFrame:
    """Both modes of every scheme in ``weights``."""
    return rebalanced(prices, weights).unionByName(buy_and_hold(prices, weights))


def month_end_curves(equity: DataFrame) -> DataFrame:
    """The curves at the last date of each month."""
    keys = ("scheme", "mode")
    monthly = month_end(equity.withColumnRenamed("value", "px"), keys)
    return monthly.select(*keys, "ts", F.col("px").alias("value"))


def backtest_metrics(equity: DataFrame, ppy: int, rf: float = 0.03) -> DataFrame:
    return curve_metrics(equity, ppy, rf)


def benchmark_curve(prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The benchmark on the portfolio's dates, filled forward and rebased."""
    return benchmark_on(prices.select("ts").distinct(), benchmark)


def benchmark_metrics(curve: DataFrame, ppy: int, rf: float = 0.03) -> DataFrame:
    """One row of metrics over the values that aren't null."""
    px = curve.where("value is not null").select(F.lit("benchmark").alias("symbol"), "ts", F.col("value").alias("px"))
    return series_metrics(px, ppy, rf).select("symbol", "cagr", "vol", "mdd", "mar", "sharpe")


def benchmark_on_months(monthly_benchmark: DataFrame, window: DataFrame) -> DataFrame:
    """``(month_idx, value)`` inside ``window(lo, hi)`` rebased to 100; nothing unless all of it is covered."""
    ends = monthly_benchmark.agg(F.min("month_idx").alias("b0"), F.max("month_idx").alias("b1"))
    whole = ends.join(F.broadcast(window), (F.col("b0") <= F.col("lo")) & (F.col("b1") >= F.col("hi"))).select("lo", "hi")
    inside = monthly_benchmark.join(F.broadcast(whole), F.col("month_idx").between(F.col("lo"), F.col("hi")))
    first = Window.partitionBy().orderBy("month_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return inside.select("month_idx", (F.try_divide(F.col("px"), F.first("px", ignorenulls=True).over(first)) * 100).alias("value"))


def edge(metrics: DataFrame, benchmark: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """``metrics`` with ``bench_cagr`` and ``edge``, the portfolio's growth over the benchmark's.

    Without a benchmark the edge is over 0, or null if ``missing_as_zero`` is off.
    """
    other = benchmark.select(F.col("cagr").alias("bench_cagr"))
    joined = metrics.join(F.broadcast(other), F.lit(True), "left")
    against = F.coalesce("bench_cagr", F.lit(0.0)) if missing_as_zero else F.col("bench_cagr")
    return joined.withColumn("edge", F.col("cagr") - against)
