"""The explorer's monthly runs: screen stored rows, weigh and test on monthly curves."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import align_on_months, aligned_returns
from ..operators.backtest import backtest_metrics, benchmark_metrics, benchmark_on_months, edge, equity_curves
from ..operators.metrics import series_metrics
from ..operators.quality import quality_score
from ..operators.screen import bounded, screen, settled, top
from ..operators.universe import missing_count, select_universes
from ..operators.weights import all_weights, renormalised
from ..params import LIVE, MONTHLY, SCHEMES, Mode, ScreenParams
from ..versions import current

LEAST_MONTHS = 36
LEAST_AFTER = 12
#: Metrics that the table of the screen shows, in order.
SHOWN = ("quality", "cagr", "vol", "mdd", "min5y", "r2", "reg", "mar", "sortino")


@dataclass(frozen=True)
class Build:
    """A portfolio on monthly curves and its backtest."""

    picks: DataFrame
    dropped: DataFrame
    weights: DataFrame
    equity: DataFrame
    metrics: DataFrame
    benchmark: DataFrame | None
    benchmark_metrics: DataFrame | None
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give back what is kept in memory; the lazy tables stay usable and are computed anew."""
        for one in self.held:
            one.unpersist()

    def with_edge(self, missing_as_zero: bool = True) -> DataFrame:
        none = self.metrics.select("cagr").limit(0)
        return edge(self.metrics, none if self.benchmark_metrics is None else self.benchmark_metrics, missing_as_zero)


def _release(*held: DataFrame) -> None:
    for one in held:
        one.unpersist()


def _dated(aligned: DataFrame) -> DataFrame:
    """Months as the order column of the series operators."""
    return aligned.select("symbol", F.col("month_idx").cast("bigint").alias("ts"), "px")


def _window(monthly: DataFrame, benchmark: DataFrame | None, start: int | None = None) -> DataFrame:
    ends = monthly.groupBy("symbol").agg(F.min("month_idx").alias("i0"), F.max("month_idx").alias("i1"))
    if benchmark is not None:
        ends = ends.unionByName(benchmark.agg(F.min("month_idx").alias("i0"), F.max("month_idx").alias("i1")).select(F.lit("").alias("symbol"), "i0", "i1"))
    lo = F.max("i0") if start is None else F.lit(start)
    return ends.agg(lo.cast("int").alias("lo"), F.min("i1").alias("hi"))


def _settled_row(window: DataFrame) -> DataFrame:
    """A one-row table computed now."""
    return window.sparkSession.createDataFrame(window.collect(), window.schema)


def _test(aligned: DataFrame, weights: DataFrame, benchmark: DataFrame | None, window: DataFrame, mode: Mode):
    equity = equity_curves(_dated(aligned), weights)
    metrics = backtest_metrics(equity, mode.ppy, mode.weights.rf)
    if benchmark is None:
        return equity, metrics, None, None
    curve = benchmark_on_months(benchmark, window)
    return equity, metrics, curve, benchmark_metrics(curve.withColumnRenamed("month_idx", "ts"), mode.ppy, mode.weights.rf)


def _build(picks: DataFrame, monthly: DataFrame, benchmark: DataFrame | None, mode: Mode, schemes: Iterable[str], params: ScreenParams) -> Build | None:
    chosen = monthly.join(bounded(picks.select("symbol").distinct(), params), "symbol", "left_semi").persist()
    window = _settled_row(_window(chosen, benchmark))
    span = window.first()
    if span["lo"] is None or span["hi"] - span["lo"] + 1 < LEAST_MONTHS:
        chosen.unpersist()
        return None
    aligned = align_on_months(chosen, window).persist()
    if aligned.select("symbol").distinct().count() < 2:
        _release(aligned, chosen)
        return None
    weights = settled(all_weights(aligned_returns(_dated(aligned)), mode.weights, schemes), params)
    used = picks.join(aligned.select("symbol").distinct(), "symbol", "left_semi")
    return Build(used, missing_count(picks, monthly), weights, *_test(aligned, weights, benchmark, window, mode), (aligned, chosen))


def recompute(
    rows: DataFrame, monthly: DataFrame, params: ScreenParams, benchmark: DataFrame | None = None, mode: Mode = LIVE, schemes: Iterable[str] = SCHEMES
) -> Build | None:
    """Screen the stored rows (of daily metrics) by quality and test the picks that have a curve on monthly prices."""
    picks = settled(screen(rows, replace(params, sort_by="quality")), params)
    return _build(picks, monthly, benchmark, mode, schemes, params)


def recompute_from(
    symbols: Sequence[str], rows: DataFrame, monthly: DataFrame, benchmark: DataFrame | None = None, mode: Mode = LIVE, schemes: Iterable[str] = SCHEMES
) -> Build | None:
    """A basket of one's own: no screen, each symbol once."""
    spark: SparkSession = rows.sparkSession
    basket = spark.createDataFrame([(s,) for s in dict.fromkeys(symbols)], "symbol string")
    params = ScreenParams(top_n=len(set(symbols)))
    return _build(settled(basket.join(rows, "symbol", "left"), params), monthly, benchmark, mode, schemes, params)


def active_build(symbols: Sequence[str], canonical: Build | None, custom: Build | None) -> Build | None:
    """The basket's build from two symbols on, else the screened one."""
    return custom if len(set(symbols)) >= 2 else canonical


def monthly_rows_before(monthly: DataFrame, cutoff: int, mode: Mode = LIVE, least_after: int = LEAST_AFTER) -> DataFrame:
    """Ranked metric rows of the months up to ``cutoff``, for series long enough before and after it."""
    least = int(mode.ppy * mode.oos_min_years + 0.5)
    sizes = monthly.groupBy("symbol").agg(
        F.count_if(F.col("month_idx") <= cutoff).alias("before"), F.count_if(F.col("month_idx") > cutoff).alias("after")
    )
    fit = sizes.where((F.col("before") >= least) & (F.col("after") >= least_after)).select("symbol")
    early = monthly.where(F.col("month_idx") <= cutoff).join(fit, "symbol", "left_semi")
    rows = series_metrics(_dated(early), mode.ppy, mode.weights.rf)
    return quality_score(rows.drop("start", "end"))


def recompute_oos(
    monthly: DataFrame,
    params: ScreenParams,
    as_of_month: int,
    benchmark: DataFrame | None = None,
    mode: Mode = LIVE,
    schemes: Iterable[str] = SCHEMES,
    least_after: int = LEAST_AFTER,
) -> Build | None:
    """Choose and weigh on the months up to the cutoff, test on those after it.

    The cutoff lies ``oos_years`` before ``as_of_month``; the two sides share no month.
    The choice is by quality, whatever the screen's table is sorted by.
    """
    cutoff = as_of_month - mode.oos_years * MONTHLY
    rows = monthly_rows_before(monthly, cutoff, mode, least_after)
    picks = settled(screen(rows, replace(params, min_years=mode.oos_min_years, ppy=mode.ppy, sort_by="quality")), params)
    chosen = monthly.join(bounded(picks.select("symbol"), params), "symbol", "left_semi").persist()
    early = chosen.where(F.col("month_idx") <= cutoff)
    aligned = align_on_months(early).persist()
    if aligned.select("symbol").distinct().count() < 2:
        _release(aligned, chosen)
        return None
    weights = settled(all_weights(aligned_returns(_dated(aligned)), mode.weights, schemes), params)
    late = chosen.where(F.col("month_idx") > cutoff).join(aligned.select("symbol").distinct(), "symbol", "left_semi")
    window = _settled_row(_window(late, benchmark, cutoff + 1))
    tested = align_on_months(late, window).persist()
    if tested.select("symbol").distinct().count() < 2:
        _release(tested, aligned, chosen)
        return None
    kept = settled(renormalised(weights, tested.select("symbol").distinct()), params)
    used = picks.join(tested.select("symbol").distinct(), "symbol", "left_semi")
    return Build(used, missing_count(picks, tested), kept, *_test(tested, kept, benchmark, window, mode), (tested, aligned, chosen))


def shown_curve(equity: DataFrame, scheme: str, held: bool = False) -> DataFrame:
    """The curve of one scheme, rebalanced or held."""
    return equity.where((F.col("scheme") == scheme) & (F.col("mode") == ("buyhold" if held else "rebal"))).select("ts", "value")


def key_figures(scheme: str, inside: Build | None, outside: Build | None, spark: SparkSession) -> DataFrame:
    """One row: growth in and out of sample, the benchmark's, the edge, Sharpe ratio and worst drawdown.

    Figures are of the rebalanced curves; those that can't be had are null, and a
    missing benchmark counts as 0 in the edge.
    """
    out = spark.range(1).select(F.lit(scheme).alias("scheme"))
    for name, build in (("is", inside), ("oos", outside)):
        columns = ("cagr", "bench_cagr", "edge", "sharpe", "mdd")
        if build is None:
            out = out.select("*", *[F.lit(None).cast("double").alias(f"{name}_{c}") for c in columns])
        else:
            row = build.with_edge().where((F.col("scheme") == scheme) & (F.col("mode") == "rebal"))
            out = out.join(F.broadcast(row.select(*[F.col(c).alias(f"{name}_{c}") for c in columns])), F.lit(True), "left")
    return out


def screen_table(rows: DataFrame, params: ScreenParams, basket: Iterable[str] = (), ascending: bool = False) -> DataFrame:
    """The screen's picks as they are shown: by the sort key, marked if in the basket, with the columns of the table."""
    shown = top(screen(rows, replace(params, sort_by="quality")), replace(params, top_n=0), ascending=ascending)
    marked = F.col("symbol").isin(list(basket)) if basket else F.lit(False)
    return shown.select(marked.alias("in_basket"), "symbol", *SHOWN)


def weight_table(build: Build, scheme: str) -> DataFrame:
    """Picks by weight in one scheme, with the share of the largest that scales a bar."""
    one = build.weights.where(F.col("scheme") == scheme).select("symbol", "weight", "wstd")
    largest = one.agg(F.max("weight").alias("largest"))
    joined = build.picks.join(one, "symbol").join(F.broadcast(largest), F.lit(True))
    return joined.withColumn("bar", F.try_divide("weight", "largest")).drop("largest").orderBy(F.desc("weight"), "symbol")


@dataclass(frozen=True)
class Loaded:
    """The stored universes a user has chosen, put together."""

    universes: tuple[str, ...]
    updated: DataFrame
    rows: DataFrame
    monthly: DataFrame
    benchmark: DataFrame

    def release(self) -> None:
        """Give back what is kept in memory."""
        _release(self.rows, self.monthly, self.benchmark)


def load(spark: SparkSession, folder: str, wanted: Sequence[str]) -> Loaded:
    """Metric rows and curves of the wanted universes, re-ranked together, with the fitting benchmark.

    A symbol in several universes counts once, for the first in the fixed order. The
    Parquet tables of the run are read, so a universe may have any number of series.
    """
    from ..operators.universe import choose_benchmark, latest_update, union_and_rank, union_curves
    from ..sources import artifacts

    chosen = select_universes(wanted)
    tables = [artifacts.stored_metrics(spark, folder, u) for u in chosen]
    curves = union_curves([artifacts.stored_curves(spark, folder, u) for u in chosen])
    headers = spark.read.parquet(f"{folder}/metrics").where(F.col("universe").isin(list(chosen))).select("updated")
    benchmarks = artifacts.read_benchmarks(spark, f"{folder}/benchmarks")
    bench = choose_benchmark(benchmarks, chosen, artifacts.stored_bench_curve(spark, folder, chosen[0]))
    return Loaded(chosen, latest_update(headers), union_and_rank(tables).persist(), curves.persist(), bench.persist())


class Library:
    """The stored universes of a folder, each choice of them loaded once.

    A choice stays loaded until the folder's meta artifact has a new version, which
    every stored run gives it, or ``most`` later choices have pushed it out.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = 4) -> None:
        self.spark, self.folder, self.most = spark, folder, most
        self._loaded: OrderedDict[tuple[str, ...], tuple[int, Loaded]] = OrderedDict()

    def load(self, wanted: Sequence[str]) -> Loaded:
        key = select_universes(wanted)
        version, _ = current(self.spark, f"{self.folder}/meta")
        held = self._loaded.pop(key, None)
        if held and held[0] != version:
            held[1].release()
            held = None
        self._loaded[key] = held or (version, load(self.spark, self.folder, key))
        while len(self._loaded) > self.most:
            self._loaded.popitem(last=False)[1][1].release()
        return self._loaded[key][1]

    def release(self) -> None:
        """Give back all that is loaded."""
        while self._loaded:
            self._loaded.popitem()[1][1].release()
