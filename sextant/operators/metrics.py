"""Risk and return metrics of every series in one pass.

All windows share one partitioning by series, and the final aggregate keeps it, so
a metric table costs one exchange of the prices whatever the number of metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import day_text, defined
from .scan import running

KEY = ("symbol",)


def _growth(later: Column, earlier: Column) -> Column:
    return F.try_divide(later, earlier) - 1


def period_returns(prices: DataFrame, keys: Sequence[str] = KEY, width: int | None = None) -> DataFrame:
    """``prices`` with ``ret``: the price over the one before, less 1; rows without a positive one before go.

    Series too long for a task are cut every ``width`` seconds, here and below.
    """
    before = running(prices, keys, "ts", {"prev": ("before", F.col("px"))}, width)
    return before.where("prev > 0").withColumn("ret", _growth(F.col("px"), F.col("prev"))).drop("prev")


def drawdown_series(prices: DataFrame, keys: Sequence[str] = KEY, width: int | None = None) -> DataFrame:
    """``prices`` with ``drawdown_pct``: percent below the highest price so far."""
    peaks = running(prices, keys, "ts", {"__peak": ("max", F.col("px"))}, width)
    return peaks.withColumn("drawdown_pct", _growth(F.col("px"), F.col("__peak")) * 100).drop("__peak")


def max_drawdown(prices: DataFrame, keys: Sequence[str] = KEY, width: int | None = None) -> DataFrame:
    """``(*keys, mdd)``: the deepest fall of each series below its highest price so far, 0 or less."""
    falls = drawdown_series(prices, keys, width).groupBy(*keys)
    return falls.agg(F.least(F.min(F.col("drawdown_pct") / 100), F.lit(0.0)).alias("mdd"))


def with_steps(prices: DataFrame, ppy: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Per point: return, drawdown, five-year return, and the residual of the log-linear fit."""
    series = Window.partitionBy(*keys).orderBy("ts")
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    positive = F.col("px") > 0
    steps = prices.select(
        *keys,
        "ts",
        "px",
        F.lag("px").over(series).alias("prev"),
        F.lag("px", int(5 * ppy + 0.5)).over(series).alias("five_ago"),
        F.max("px").over(so_far).alias("peak"),
        F.when(positive, F.count(F.when(positive, 1)).over(so_far) - 1).alias("x"),
        F.when(positive, F.ln(F.when(positive, F.col("px")))).alias("y"),
    )
    centred = steps.select(
        *keys,
        "ts",
        "px",
        F.when(F.col("prev") > 0, _growth(F.col("px"), F.col("prev"))).alias("ret"),
        _growth(F.col("px"), F.col("peak")).alias("drawdown"),
        _growth(F.col("px"), F.col("five_ago")).alias("five_year"),
        "y",
        (F.col("x") - F.avg("x").over(whole)).alias("dx"),
        (F.col("y") - F.avg("y").over(whole)).alias("dy"),
    )
    slope = F.try_divide(F.sum(F.col("dx") * F.col("dy")).over(whole), F.sum(F.col("dx") * F.col("dx")).over(whole))
    return centred.withColumn("miss", F.col("dy") - slope * F.col("dx"))


def series_metrics(prices: DataFrame, ppy: int, rf: float = 0.03, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per series of ``prices(*keys, ts, px)`` with all metrics; undefined ones are null.

    Years are points over ``ppy``. The five-year return goes by rows, not dates. The
    log-linear fit is taken about the means and its residuals one by one, so a perfect
    exponential has a residual of rounding size. Only positive prices count for ``cagr``, ``r2`` and ``reg``.
    """
    steps = with_steps(prices, ppy, keys)
    positive = F.when(F.col("px") > 0, F.col("px"))
    at = F.when(F.col("px") > 0, F.col("ts"))
    down = F.when(F.col("ret") < 0, F.col("ret") * F.col("ret"))
    sums = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        day_text(F.min("ts")).alias("start"),
        day_text(F.max("ts")).alias("end"),
        F.count(positive).alias("n"),
        F.min_by(positive, at).alias("first"),
        F.max_by(positive, at).alias("last"),
        F.stddev_samp("ret").alias("sd"),
        F.count("ret").alias("n_ret"),
        F.count(down).alias("n_down"),
        F.sum(down).alias("down"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("mdd"),
        F.min("five_year").alias("min5y"),
        F.sqrt(F.avg(F.col("miss") * F.col("miss"))).alias("reg"),
        F.sum(F.col("dx") * F.col("dx")).alias("sxx"),
        F.sum(F.col("dx") * F.col("dy")).alias("sxy"),
        F.sum(F.col("dy") * F.col("dy")).alias("syy"),
        (F.min("y") == F.max("y")).alias("flat"),
    )
    enough = F.col("n") >= 30
    r = F.col("sxy") * F.col("sxy")
    root = F.sqrt(F.lit(float(ppy)))
    fits = sums.select(
        *keys,
        "days",
        "start",
        "end",
        defined(F.when(F.col("n") >= 2, F.pow(F.try_divide(F.col("last"), F.col("first")), F.lit(float(ppy)) / F.col("n")) - 1)).alias("cagr"),
        F.when(F.col("n_ret") >= 2, F.col("sd") * root).alias("vol"),
        F.when(F.col("n_down") >= 2, F.sqrt(F.col("down") / F.col("n_down")) * root).alias("dvol"),
        "mdd",
        "min5y",
        F.when(enough & ~F.col("flat"), F.try_divide(r, F.col("sxx") * F.col("syy"))).alias("r2"),
        F.when(enough, F.col("reg")).alias("reg"),
    )
    excess = F.col("cagr") - F.lit(rf)
    return fits.select(
        *keys,
        *["days", "start", "end", "cagr", "vol", "mdd", "min5y", "r2", "reg"],
        F.try_divide("cagr", F.abs("mdd")).alias("mar"),
        F.when(F.col("dvol") > 0, F.try_divide(excess, F.col("dvol"))).alias("sortino"),
        F.try_divide(excess, F.col("vol")).alias("sharpe"),
        F.try_divide(F.col("cagr"), F.col("vol") * F.abs("mdd")).alias("score"),
        "dvol",
    )


def universe_metrics(prices: DataFrame, ppy: int, rf: float = 0.03, least: int = 30) -> DataFrame:
    """Metric rows of every series with ``least`` points; ``ccy`` is the original currency."""
    ccy = prices.groupBy("symbol").agg(F.first("currency", ignorenulls=True).alias("ccy")) if "currency" in prices.columns else None
    rows = series_metrics(prices, ppy, rf).where(F.col("days") >= least)
    if ccy is None:
        return rows.withColumn("ccy", F.lit(None).cast("string"))
    return rows.join(ccy, "symbol", "left")


def curve_metrics(equity: DataFrame, ppy: int, rf: float = 0.03, keys: Sequence[str] = ("scheme", "mode")) -> DataFrame:
    """``cagr, vol, mdd, mar, sharpe`` of each equity curve ``(*keys, ts, value)``."""
    rows = series_metrics(equity.withColumnRenamed("value", "px"), ppy, rf, keys)
    return rows.select(*keys, "cagr", "vol", "mdd", "mar", "sharpe")
