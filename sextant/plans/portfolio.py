"""From a universe of prices to a portfolio and its backtests, in and out of sample."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import align_on_dates, aligned_returns, time_slice
from ..operators.backtest import backtest_metrics, benchmark_curve, benchmark_metrics, edge, equity_curves, month_end_curves
from ..operators.metrics import universe_metrics
from ..operators.quality import quality_score
from ..operators.screen import bounded, screen, settled
from ..operators.weights import all_weights, renormalised
from ..params import BATCH, SCHEMES, YEAR_SECONDS, Mode, ScreenParams

#: Points a pick needs before, and after the cutoff.
USABLE_POINTS = 252
SURVIVOR_POINTS = 60


@dataclass(frozen=True)
class Portfolio:
    picks: DataFrame
    prices: DataFrame
    weights: DataFrame

    def release(self) -> None:
        """Give back the aligned prices that are kept in memory."""
        self.prices.unpersist()

    def info(self) -> DataFrame:
        """Each pick's metric row beside its weight and spread in every scheme."""
        out = self.picks
        for scheme in SCHEMES:
            one = self.weights.where(F.col("scheme") == scheme)
            out = out.join(one.select("symbol", F.col("weight").alias(f"w_{scheme}"), F.col("wstd").alias(f"sd_{scheme}")), "symbol", "left")
        return out


@dataclass(frozen=True)
class Backtest:
    equity: DataFrame
    metrics: DataFrame
    benchmark: DataFrame | None
    benchmark_metrics: DataFrame | None

    def with_edge(self, missing_as_zero: bool = True) -> DataFrame:
        none = self.metrics.select("cagr").limit(0)
        return edge(self.metrics, none if self.benchmark_metrics is None else self.benchmark_metrics, missing_as_zero)


def ranked_universe(prices: DataFrame, mode: Mode = BATCH, undefined_as_zero: bool = False) -> DataFrame:
    """Metric rows of every series with their quality."""
    return quality_score(universe_metrics(prices, mode.ppy, mode.weights.rf), undefined_as_zero)


def usable_picks(picks: DataFrame, prices: DataFrame, more_than: int) -> DataFrame:
    """The picks that have more points than ``more_than``."""
    long = prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than).select("symbol")
    return picks.join(long, "symbol", "left_semi")


def prices_of(prices: DataFrame, picks: DataFrame, params: ScreenParams) -> DataFrame:
    """The picks' points; picks that ``top_n`` bounds are broadcast, so the prices aren't shuffled."""
    return prices.join(bounded(picks.select("symbol").distinct(), params), "symbol", "left_semi").select("symbol", "ts", "px")


def build_portfolio(
    rows: DataFrame,
    prices: DataFrame,
    params: ScreenParams,
    mode: Mode = BATCH,
    schemes: Iterable[str] = SCHEMES,
    usable: int = USABLE_POINTS,
    key: str = "ts",
) -> Portfolio | None:
    """Screen ``rows`` by quality, align the picks' prices and weigh them.

    None if under two picks are usable or they share too few dates. Of the prices only
    those of the picks are read, once.
    """
    best = settled(screen(rows, replace(params, sort_by="quality")), params)
    own = prices_of(prices, best, params).persist()
    picks = settled(usable_picks(best, own, usable), params)
    aligned = align_on_dates(prices_of(own, picks, params), key).persist()
    size = aligned.agg(F.count_distinct("symbol").alias("k"), F.count_distinct("ts").alias("n")).first()
    own.unpersist()
    if size["k"] < 2 or size["n"] - 1 < mode.least_returns:
        aligned.unpersist()
        return None
    weights = settled(all_weights(aligned_returns(aligned), mode.weights, schemes), params)
    return Portfolio(picks, aligned, weights)


def backtest(prices: DataFrame, weights: DataFrame, benchmark: DataFrame | None = None, mode: Mode = BATCH, monthly_curves: bool = True) -> Backtest | None:
    """Curves of all schemes and modes over aligned prices; metrics are of the full curves."""
    if prices.select("ts").distinct().count() < mode.least_points:
        return None
    equity = equity_curves(prices, weights)
    metrics = backtest_metrics(equity, mode.ppy, mode.weights.rf)
    shown = month_end_curves(equity) if monthly_curves else equity
    if benchmark is None:
        return Backtest(shown, metrics, None, None)
    curve = benchmark_curve(prices, benchmark)
    return Backtest(shown, metrics, curve, benchmark_metrics(curve, mode.ppy, mode.weights.rf))


@dataclass(frozen=True)
class OutOfSample:
    cutoff: int
    portfolio: Portfolio
    weights: DataFrame
    backtest: Backtest
    prices: DataFrame
    measured: DataFrame

    def release(self) -> None:
        """Give back what is kept in memory."""
        self.portfolio.release()
        self.prices.unpersist()
        self.measured.unpersist()


def out_of_sample(
    prices: DataFrame,
    params: ScreenParams,
    as_of: int,
    benchmark: DataFrame | None = None,
    mode: Mode = BATCH,
    schemes: Iterable[str] = SCHEMES,
    usable: int = USABLE_POINTS,
    survivor: int = SURVIVOR_POINTS,
) -> OutOfSample | None:
    """Choose and weigh on prices up to the cutoff, test on those from it; both sides have the cutoff itself.

    ``as_of`` is the epoch second from which the cutoff counts back. Picks that end
    too soon after it go and the rest are scaled to 1. None if nothing can be tested.
    The prices are read three times: for the metrics before the cutoff, which are
    kept, and for the picks' points on either side.
    """
    cutoff = int(as_of) - mode.oos_years * YEAR_SECONDS
    before = time_slice(prices, end=cutoff)
    measured = universe_metrics(before, mode.ppy, mode.weights.rf).persist()
    chosen = build_portfolio(quality_score(measured), before, replace(params, min_years=mode.oos_min_years), mode, schemes, usable)
    if chosen is None:
        measured.unpersist()
        return None
    after = time_slice(prices_of(prices, chosen.picks, params), start=cutoff).persist()
    alive = settled(usable_picks(chosen.picks, after, survivor), params)
    weights = settled(renormalised(chosen.weights, alive), params)
    aligned = align_on_dates(prices_of(after, alive, params)).persist()
    tested = backtest(aligned, weights, benchmark, mode) if aligned.select("symbol").distinct().count() >= 2 else None
    after.unpersist()
    if tested is None:
        for kept in (aligned, measured):
            kept.unpersist()
        chosen.release()
        return None
    return OutOfSample(cutoff, chosen, weights, tested, aligned, measured)
