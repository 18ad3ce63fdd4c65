"""The batch run of a universe: from raw series to its stored artifacts."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.fx import needed_currencies, to_base
from ..operators.resample import month_end, to_segments
from ..operators.universe import MIXED_INDEX, eligible_pool, pool_sizes
from ..params import BATCH, SCHEMES, Mode, ScreenParams, Universe
from ..schemas import PRICES
from ..sources.chart_api import download
from ..sources.series import fx_of, fx_symbol, missing_rates, series_of, usable_series
from .portfolio import Backtest, OutOfSample, Portfolio, backtest, build_portfolio, out_of_sample, ranked_universe

log = logging.getLogger(__name__)

# The indices stored for comparison.
GLOBAL_BENCHMARKS = {"^GSPC": "S&P 500", "^NYA": "NYSE Composite", "^IXIC": "NASDAQ Composite", "^STOXX": "STOXX Europe 600", MIXED_INDEX: "MSCI ACWI"}
DEFAULT_UNIVERSE = "SP500"
BENCHMARKS_ONLY = "BENCH"


@dataclass(frozen=True)
class UniverseRun:
    """What a batch run of one universe gives; tables are lazy."""

    universe: Universe
    prices: DataFrame
    rows: DataFrame
    portfolio: Portfolio | None
    inside: Backtest | None
    outside: OutOfSample | None
    benchmark: DataFrame
    series: DataFrame

    def release(self) -> None:
        """Give back what the run keeps in memory."""
        for kept in (self.outside, self.portfolio):
            if kept is not None:
                kept.release()
        for table in (self.rows, self.prices, self.benchmark, self.series):
            table.unpersist()

    def pool(self, ppy: int) -> DataFrame:
        """Prices of the series whose curves are stored."""
        kept = eligible_pool(self.rows, ppy=ppy).select("symbol")
        return self.prices.join(kept, "symbol", "left_semi")

    def meta(self, ppy: int, updated: str) -> DataFrame:
        """One row for the meta artifact: series, and those whose curves are stored."""
        return pool_sizes(self.rows, ppy=ppy).select(F.lit(self.universe.id).alias("universe"), "count", "eligible", F.lit(updated).alias("updated"))


def requested(arguments: Sequence[str]) -> tuple[str, ...]:
    """The universes a command line asks for: none means the default, the benchmarks' word alone none at all."""
    if list(arguments) == [BENCHMARKS_ONLY]:
        return ()
    return tuple(a for a in arguments if a != BENCHMARKS_ONLY) or (DEFAULT_UNIVERSE,)


def counted(points: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``points`` that report what is wrong with them once an action has run."""
    seen = Observation(name)
    bad = ~F.coalesce((F.col("px") > 0) & (F.col("px") < F.lit(float("inf"))), F.lit(False))
    watched = points.observe(seen, F.count(F.lit(1)).alias("points"), F.count_if(bad).alias("unusable"), F.count_if(F.col("currency").isNull()).alias("no_currency"))
    return watched, seen


def report(name: str, seen: Observation) -> dict[str, int]:
    """Log what a counted table has shown: its points, and warnings of what can't be used."""
    found = {k: int(v) for k, v in seen.get.items()}
    log.info("%s: %d points read", name, found["points"])
    for what, words in (("unusable", "points that aren't positive numbers"), ("no_currency", "points without a currency, taken as USD")):
        if found[what]:
            log.warning("%s: %d %s", name, found[what], words)
    return found


def download_raw(symbols: DataFrame, benchmarks: Sequence[str], hosts: list[str], folder: str, **options) -> DataFrame:
    """What a run reads: the series of ``symbols(symbol)`` and ``benchmarks``, then the pairs of the currencies they come in.

    Each part is stored under ``folder`` before it is read. ``options`` are those of ``download``.
    """
    spark = symbols.sparkSession
    wanted = symbols.select("symbol").unionByName(spark.createDataFrame([(b,) for b in benchmarks], "symbol string"))

    def stored(asked: DataFrame, part: str) -> DataFrame:
        download(asked, hosts, **options).write.mode("overwrite").parquet(f"{folder}/{part}")
        found = spark.read.schema(PRICES).parquet(f"{folder}/{part}")
        log.info("%s: %d of %d downloaded", part, found.select("symbol").distinct().count(), asked.distinct().count())
        return found

    found = stored(wanted, "series")
    pairs = needed_currencies(found).select(F.format_string(fx_symbol("%s"), "ccy").alias("symbol"))
    return found.unionByName(stored(pairs, "rates"))


def converted(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """The universe's series in the base currency, from raw prices that hold the currency pairs too."""
    own = usable_series(raw.join(symbols.select("symbol").distinct(), "symbol", "left_semi"))
    return _converted(own, raw)


def _converted(own: DataFrame, raw: DataFrame) -> DataFrame:
    rates = fx_of(usable_series(raw))
    lacking = [r["ccy"] for r in missing_rates(needed_currencies(own), rates).collect()]
    if lacking:
        log.warning("no rates for %s; their series are left out", ", ".join(sorted(lacking)))
    return to_base(own, rates)


def converted_benchmark(raw: DataFrame, symbol: str, symbols: DataFrame) -> DataFrame:
    """``(ts, px)`` of a benchmark in the base currency, empty if its own currency isn't among the universe's.

    Only the currencies of the universe's series have rates in a run.
    """
    known = needed_currencies(raw.join(symbols.select("symbol").distinct(), "symbol", "left_semi"))
    rates = fx_of(usable_series(raw)).join(known, "ccy", "left_semi")
    return to_base(usable_series(series_of(raw, [symbol])), rates).select("ts", "px")


def run_universe(
    universe: Universe,
    symbols: DataFrame,
    raw: DataFrame,
    params: ScreenParams,
    as_of: int,
    mode: Mode = BATCH,
    schemes: Sequence[str] = SCHEMES,
) -> UniverseRun:
    """Metrics, portfolio and both backtests of a universe over ``raw(symbol, currency, ts, px)``.

    The converted prices and metric rows are kept for the run, as every later step reads them.
    """
    watched, seen = counted(raw.join(symbols.select("symbol").distinct(), "symbol", "left_semi"), f"points of {universe.id}")
    series = usable_series(watched).persist()
    log.info("%s: %d usable points", universe.id, series.count())
    report(universe.id, seen)
    prices = _converted(series, raw).persist()
    rows = ranked_universe(prices, mode).persist()
    benchmark = converted_benchmark(raw, universe.benchmark, symbols).persist()
    built = build_portfolio(rows, prices, params, mode, schemes, usable=mode.ppy)
    inside = backtest(built.prices, built.weights, benchmark, mode) if built else None
    outside = out_of_sample(prices, params, as_of, benchmark, mode, schemes, usable=mode.ppy, survivor=min(60, 5 * mode.ppy)) if built else None
    return UniverseRun(universe, prices, rows, built, inside, outside, benchmark, series)


def store(run: UniverseRun, folder: str, params: ScreenParams, updated: str, mode: Mode = BATCH) -> None:
    """Write a run's metric, curve, portfolio and meta artifacts under ``folder``.

    Metric rows and month segments go out as Parquet by universe, one row a series, which
    the explorer reads, and as JSON documents. The meta artifact comes last: its version
    tells readers that the tables have changed.
    """
    from ..sinks import artifacts as sink

    u = run.universe
    sink.write_table(sink.rounded_metrics(run.rows).withColumn("updated", F.lit(updated)), f"{folder}/metrics", u.id)
    sink.write_table(to_segments(month_end(run.pool(mode.ppy))), f"{folder}/curves", u.id)
    bench = run.benchmark.withColumn("symbol", F.lit(u.benchmark))
    sink.write_table(to_segments(month_end(bench)), f"{folder}/bench", u.id)
    header = {k: v for k, v in asdict(params).items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    sink.write_metrics(run.rows, f"{folder}/metrics_{u.id}", universe=u.id, label=u.label, updated=updated, params=header)
    sink.write_curves(run.pool(mode.ppy).select("symbol", "ts", "px"), f"{folder}/curves_{u.id}", updated, run.benchmark)
    if run.portfolio and run.inside:
        document = sink.portfolio_document(run.portfolio, run.inside, run.outside, u, run.rows, params, updated, mode.oos_min_years)
        document.write.mode("overwrite").text(f"{folder}/portfolio_{u.id}")
    sink.upsert_meta(run.meta(mode.ppy, updated), f"{folder}/meta", updated)


def store_benchmarks(raw: DataFrame, folder: str, updated: str, labels: Mapping[str, str] = GLOBAL_BENCHMARKS) -> None:
    """Write the comparison indices, each converted with its own currency's rate."""
    from ..sinks import artifacts as sink

    found = to_base(usable_series(series_of(raw, list(labels))), fx_of(usable_series(raw)))
    sink.benchmarks_document(found.select("symbol", "ts", "px"), dict(labels), updated).write.mode("overwrite").text(f"{folder}/benchmarks")


def run_all(
    spark: SparkSession,
    arguments: Sequence[str],
    config: str,
    raw: DataFrame,
    folder: str,
    params: ScreenParams,
    as_of: int,
    updated: str,
    mode: Mode = BATCH,
    schemes: Sequence[str] = SCHEMES,
) -> list[str]:
    """The command line's run: each universe in turn, then the benchmarks. Returns the ids that ran."""
    from ..sources.universes import load_symbols, read_universe

    done = []
    for wanted in requested(arguments):
        universe = read_universe(spark, config, wanted)
        run = run_universe(universe, load_symbols(spark, universe), raw, params, as_of, mode, schemes)
        store(run, folder, params, updated, mode)
        run.release()
        done.append(wanted)
        log.info("%s stored, %d of %d universes", wanted, len(done), len(requested(arguments)))
    store_benchmarks(raw, folder, updated)
    return done
