"""The engine's queries over the warehouse panels, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import month_text
from .operators import align, backtest, fx, metrics, quality, resample, screen, universe, weights
from .params import BATCH, DAILY, LIVE, MONTHLY, Mode, ScreenParams, WeightParams
from .plans import explorer, panels, portfolio
from .sinks import artifacts
from .sources import series

#: Thresholds that noise can pass; the production ones reject every made-up series.
LOOSE = ScreenParams(min_years=5, tolerance_5y=-0.99, min_r2=0.0, min_cagr=None, max_drawdown=None, ppy=MONTHLY)
STRICT = ScreenParams(min_years=6, tolerance_5y=-0.35, min_r2=0.004, min_cagr=-0.02, max_drawdown=-0.75, ppy=MONTHLY)
SHORT_PPY = 24
#: Fixed dates of the slices: the years 1996 to 1999, and the start of 1999.
SLICE = (820_454_400, 946_684_799)
CUTOFF = 915_148_800
TEST_MODE = Mode("test", MONTHLY, WeightParams(ppy=MONTHLY), least_returns=20, least_points=12, oos_min_years=2)
BENCH_NAMES = {"AF": "^GSPC", "NF": "ACWI", "RF": "^STOXX"}
BASKET = ("S000001", "S000003", "S000007", "S000001")
#: The month, counted from year 0, up to which the explorer's out-of-sample run chooses.
OOS_MONTH = 1999 * 12
MICROS = 30 * 86_400 * 1_000_000
YEAR = 365 * 86_400


def _r(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def _ranked(months: DataFrame) -> DataFrame:
    return quality.quality_score(metrics.universe_metrics(months, MONTHLY))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(panels.supplier_months(spark, sf_dir))


@contextmanager
def _kept(table: DataFrame) -> Iterator[DataFrame]:
    """``table`` in memory for the actions of a run."""
    try:
        yield table.persist()
    finally:
        table.unpersist()


def _finished(run: explorer.Build | portfolio.Portfolio | portfolio.OutOfSample, rows: DataFrame) -> DataFrame:
    """What a run gives, computed now so that the run can give back its memory: a row per pick, scheme or month."""
    done = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
    run.release()
    return done


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, quality and screen of the supplier series."""
    picks = screen.screen(_rows(spark, sf_dir), LOOSE)
    return picks.select("symbol", "days", "start", "end", *_r("cagr", "vol", "mdd", "min5y", "r2", "reg", "mar", "sortino", "sharpe", "quality"))


def q_period_returns(spark, sf_dir):
    return metrics.period_returns(panels.supplier_months(spark, sf_dir)).select("symbol", "ts", *_r("ret"))


def _one_metric(*names: str):
    def query(spark, sf_dir):
        return metrics.series_metrics(panels.supplier_months(spark, sf_dir), MONTHLY).select("symbol", *_r(*names))

    return query


def q_drawdown_series(spark, sf_dir):
    return metrics.drawdown_series(panels.supplier_months(spark, sf_dir)).select("symbol", "ts", *_r("drawdown_pct"))


def q_drawdown_split(spark, sf_dir):
    """The deepest falls of daily series, cut every year."""
    return metrics.max_drawdown(panels.supplier_days(spark, sf_dir), width=YEAR).select("symbol", *_r("mdd"))


def q_returns_split(spark, sf_dir):
    """Returns of daily series, cut every year."""
    return metrics.period_returns(panels.supplier_days(spark, sf_dir), width=YEAR).select("symbol", "ts", *_r("ret"))


def q_rebalanced_split(spark, sf_dir):
    """The rebalanced curve on common days, prices and curve cut every year; its logarithm, as daily noise compounds beyond all digits."""
    prices = _aligned(spark, sf_dir)
    curve = backtest.rebalanced(prices, weights.equal_weights(prices.select("symbol").distinct()), width=YEAR)
    return curve.select("scheme", "mode", "ts", F.round(F.ln("value"), 6).alias("log_value"))


def q_metrics_all(spark, sf_dir):
    rows = metrics.universe_metrics(panels.supplier_days(spark, sf_dir), DAILY)
    return rows.select("symbol", "days", "start", "end", *_r("cagr", "vol", "mdd", "min5y", "r2", "reg", "mar", "sortino", "sharpe", digits=5))


def q_percentile_ranks(spark, sf_dir):
    rows = metrics.series_metrics(panels.supplier_months(spark, sf_dir), MONTHLY)
    return quality.percentile_ranks(rows, quality.PARTS).select("symbol", *_r(*[f"rank_{p}" for p in quality.PARTS]))


def q_quality_score(spark, sf_dir):
    return _rows(spark, sf_dir).select("symbol", *_r("quality"))


def q_screen_picks(spark, sf_dir):
    return screen.screen(_rows(spark, sf_dir), STRICT).select("symbol", "days", *_r("quality"))


def q_screen_reject_counts(spark, sf_dir):
    return screen.reject_counts(_rows(spark, sf_dir), STRICT).select("reason", "n")


def q_screen_summary(spark, sf_dir):
    return screen.screen_summary(_rows(spark, sf_dir), STRICT)


def q_screen_ascending(spark, sf_dir):
    best = screen.top(screen.survivors(_rows(spark, sf_dir), STRICT), replace(STRICT, sort_by="cagr", top_n=5), ascending=True)
    return best.select("symbol", *_r("cagr"))


def _short_rows(spark, sf_dir, as_zero: bool):
    """At 24 periods a year no series has five years, so none has a five-year return."""
    rows = quality.quality_score(metrics.series_metrics(panels.supplier_months(spark, sf_dir), SHORT_PPY), as_zero)
    params = replace(STRICT, min_years=3, tolerance_5y=0.01, undefined_as_zero=as_zero)
    return screen.with_reason(rows, params).select("symbol", "reject_reason", *_r("quality"))


def q_screen_undefined_passes(spark, sf_dir):
    return _short_rows(spark, sf_dir, False)


def q_screen_undefined_as_zero(spark, sf_dir):
    return _short_rows(spark, sf_dir, True)


def q_month_end(spark, sf_dir):
    monthly = resample.month_end(panels.supplier_days(spark, sf_dir))
    return monthly.select("symbol", month_text(F.col("month_idx")).alias("month"), "ts", *_r("px"))


def q_fx_convert_asof(spark, sf_dir):
    converted = fx.to_base(panels.purchases(spark, sf_dir), panels.view_rates(spark, sf_dir), block=MICROS)
    return converted.select("symbol", "currency", "ts", *_r("px"))


def q_needed_currencies(spark, sf_dir):
    return fx.needed_currencies(panels.purchases(spark, sf_dir))


def _aligned(spark, sf_dir):
    return align.align_on_dates(panels.flag_days(spark, sf_dir))


def q_align_intersection(spark, sf_dir):
    return _aligned(spark, sf_dir).select("symbol", "ts", *_r("px"))


def q_benchmark_locf_rebased(spark, sf_dir):
    dates = _aligned(spark, sf_dir).select("ts").distinct()
    return align.benchmark_on(dates, panels.urgent_days(spark, sf_dir)).select("ts", *_r("value"))


def q_cov_matrix(spark, sf_dir):
    return weights.cov_matrix(align.aligned_returns(_aligned(spark, sf_dir))).select("a", "b", *_r("cov"))


def q_col_means(spark, sf_dir):
    return weights.col_means(align.aligned_returns(_aligned(spark, sf_dir))).select("symbol", *_r("mean_ret"))


def q_weights_equal(spark, sf_dir):
    return weights.equal_weights(_aligned(spark, sf_dir).select("symbol").distinct()).select("scheme", "symbol", *_r("weight"))


def q_weights_invvol(spark, sf_dir):
    return weights.inverse_vol_weights(align.aligned_returns(_aligned(spark, sf_dir))).select("scheme", "symbol", *_r("weight"))


def q_portfolio_statistics(spark, sf_dir):
    prices = _aligned(spark, sf_dir)
    w = weights.equal_weights(prices.select("symbol").distinct())
    return weights.portfolio_statistics(w, align.aligned_returns(prices), BATCH.weights).select("scheme", *_r("expected_return", "volatility", "sharpe"))


def _aligned_months(spark, sf_dir):
    return align.align_on_dates(panels.flag_days(spark, sf_dir, "month"))


def _equal_curves(spark, sf_dir):
    prices = _aligned_months(spark, sf_dir)
    return backtest.equity_curves(prices, weights.equal_weights(prices.select("symbol").distinct()))


def q_backtest_rebalanced(spark, sf_dir):
    return _equal_curves(spark, sf_dir).where("mode = 'rebal'").select("scheme", "mode", "ts", *_r("value", digits=4))


def q_backtest_buyhold(spark, sf_dir):
    return _equal_curves(spark, sf_dir).where("mode = 'buyhold'").select("scheme", "mode", "ts", *_r("value", digits=4))


def q_backtest_metrics(spark, sf_dir):
    return backtest.backtest_metrics(_equal_curves(spark, sf_dir), MONTHLY).select("scheme", "mode", *_r("cagr", "vol", "mdd", "mar", "sharpe", digits=5))


def q_edge(spark, sf_dir):
    curve = backtest.benchmark_curve(_aligned_months(spark, sf_dir), panels.urgent_days(spark, sf_dir, "month"))
    rows = backtest.edge(backtest.backtest_metrics(_equal_curves(spark, sf_dir), MONTHLY), backtest.benchmark_metrics(curve, MONTHLY))
    return rows.select("scheme", "mode", *_r("cagr", "bench_cagr", "edge", digits=5))


def q_time_slice(spark, sf_dir):
    return align.time_slice(panels.flag_days(spark, sf_dir), *SLICE).select("symbol", "ts", *_r("px"))


def q_oos_equal(spark, sf_dir):
    loose = replace(LOOSE, ppy=MONTHLY)
    as_of = CUTOFF + TEST_MODE.oos_years * 365 * 86_400
    with _kept(panels.flag_days(spark, sf_dir, "month")) as prices:
        found = portfolio.out_of_sample(prices, loose, as_of, mode=TEST_MODE, schemes=("equal",), usable=20, survivor=6)
        if found is None:
            return spark.createDataFrame([], "scheme string, mode string, cagr double, vol double, mdd double")
        return _finished(found, found.backtest.metrics.select("scheme", "mode", *_r("cagr", "vol", "mdd", digits=5)))


def _gapless(months: DataFrame) -> DataFrame:
    return resample.without_gaps(resample.month_end(months)).select("symbol", "month_idx", "px")


def _monthly(spark, sf_dir):
    return _gapless(panels.supplier_months(spark, sf_dir))


def q_live_common_window(spark, sf_dir):
    window = align.common_window(_monthly(spark, sf_dir))
    return window.select(month_text(F.col("lo")).alias("first_month"), month_text(F.col("hi")).alias("last_month"), (F.col("hi") - F.col("lo") + 1).cast("bigint").alias("months"))


def q_live_backtest_equal(spark, sf_dir):
    """The explorer's run: screen, keep picks with a curve, common months, equal weights, both modes."""
    with _kept(panels.supplier_months(spark, sf_dir)) as months:
        built = explorer.recompute(_ranked(months), _gapless(months), replace(LOOSE, top_n=8), schemes=("equal",))
        if built is None:
            return spark.createDataFrame([], "mode string, month string, value double")
        return _finished(built, built.equity.select("mode", month_text(F.col("ts")).alias("month"), *_r("value", digits=4)))


def q_universe_union_rerank(spark, sf_dir):
    """Overlapping universes ranked together, a series for the first that lists it; each is measured once."""
    listed = panels.supplier_regions(spark, sf_dir)
    members = universe.union_first_wins([listed.where(F.col("universe") == u) for u in range(5)])
    rows = metrics.universe_metrics(panels.supplier_months(spark, sf_dir), MONTHLY)
    merged = universe.union_and_rank([rows.join(members.drop("universe_ord"), "symbol")])
    return merged.select("symbol", F.col("universe").cast("bigint").alias("universe"), *_r("quality"))


def q_eligible_pool(spark, sf_dir):
    return universe.eligible_pool(_rows(spark, sf_dir), 6, 0.004, MONTHLY).select("symbol", "days", *_r("r2"))


def q_curve_segments(spark, sf_dir):
    packed = resample.to_segments(_monthly(spark, sf_dir), digits=None)
    return packed.select(
        "symbol",
        "start_month",
        F.size("p").cast("bigint").alias("n"),
        F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 3).alias("total"),
        F.round(F.element_at("p", -1), 6).alias("last_px"),
    )


def q_segment_round_trip(spark, sf_dir):
    back = resample.from_segments(resample.to_segments(_monthly(spark, sf_dir), digits=None))
    return back.select("symbol", month_text(F.col("month_idx")).alias("month"), *_r("px"))


def q_curve_union(spark, sf_dir):
    """Curves that differ by universe: a symbol's comes from the first that has it."""
    members = panels.supplier_regions(spark, sf_dir).distinct()
    curves = _monthly(spark, sf_dir).join(members, "symbol").select("symbol", "month_idx", (F.col("px") * (F.col("universe") + 1)).alias("px"), F.col("universe").alias("universe_ord"))
    return universe.first_curves(curves).select("symbol", month_text(F.col("month_idx")).alias("month"), *_r("px"))


def q_missing_count(spark, sf_dir):
    """Series without a gapless curve."""
    return universe.missing_count(panels.supplier_months(spark, sf_dir), _monthly(spark, sf_dir))


def q_screen_table(spark, sf_dir):
    shown = explorer.screen_table(_rows(spark, sf_dir), STRICT, ["S000001", "S000003"])
    return shown.select("in_basket", "symbol", *_r(*explorer.SHOWN))


def q_metrics_stored(spark, sf_dir):
    """Metric rows with the digits of the artifact."""
    return artifacts.rounded_metrics(_rows(spark, sf_dir)).select("symbol", *artifacts.DIGITS)


def q_benchmark_choice(spark, sf_dir):
    """The index that two regions together are compared with."""
    names = F.create_map(*[F.lit(x) for pair in BENCH_NAMES.items() for x in pair])
    monthly = resample.month_end(panels.flag_days(spark, sf_dir)).withColumn("symbol", names[F.col("symbol")]).where("symbol is not null")
    chosen = universe.choose_benchmark(monthly, ["STOXX600", "SP500"])
    return chosen.select(month_text(F.col("month_idx")).alias("month"), *_r("px"))


def _market(spark, sf_dir):
    return resample.month_end(panels.market_months(spark, sf_dir).withColumn("symbol", F.lit("market"))).select("month_idx", "px")


def q_benchmark_on_months(spark, sf_dir):
    """A monthly benchmark over the months that all series share, rebased."""
    curve = backtest.benchmark_on_months(_market(spark, sf_dir), align.common_window(_monthly(spark, sf_dir)))
    return curve.select(month_text(F.col("month_idx")).alias("month"), *_r("value"))


def q_chart_points(spark, sf_dir):
    """Usable points of chart payloads, from adjusted closes where a payload has them."""
    return series.payload_points(panels.customer_payloads(spark, sf_dir)).select("symbol", "currency", "ts", *_r("px"))


def q_latest_update(spark, sf_dir):
    """The latest date among the headers of several tables."""
    return universe.latest_update(panels.order_headers(spark, sf_dir))


def q_pick_info(spark, sf_dir):
    """Picks beside their metrics and weights."""
    with _kept(panels.flag_days(spark, sf_dir, "month")) as prices:
        built = portfolio.build_portfolio(portfolio.ranked_universe(prices, TEST_MODE), prices, LOOSE, TEST_MODE, ("equal",), usable=20)
        if built is None:
            return spark.createDataFrame([], "symbol string, days bigint, cagr double, quality double, w_equal double")
        return _finished(built, built.info().select("symbol", "days", *_r("cagr", "quality", "w_equal")))


def q_basket_equal(spark, sf_dir):
    """A basket of one's own, one symbol named twice: no screen, equal weights, held."""
    with _kept(panels.supplier_months(spark, sf_dir)) as months:
        built = explorer.recompute_from(BASKET, _ranked(months), _gapless(months), schemes=("equal",))
        if built is None:
            return spark.createDataFrame([], "month string, value double")
        held = explorer.shown_curve(built.equity, "equal", held=True)
        return _finished(built, held.select(month_text(F.col("ts")).alias("month"), *_r("value", digits=4)))


def q_weight_table(spark, sf_dir):
    """The explorer's picks by weight, with the share of the largest."""
    mode = replace(LIVE, weights=replace(LIVE.weights, floor=0.02, cap=0.20))
    with _kept(panels.supplier_months(spark, sf_dir)) as months:
        built = explorer.recompute(_ranked(months), _gapless(months), replace(LOOSE, top_n=8), mode=mode, schemes=("invvol",))
        if built is None:
            return spark.createDataFrame([], "symbol string, weight double, bar double")
        return _finished(built, explorer.weight_table(built, "invvol").select("symbol", *_r("weight"), *_r("bar", digits=4)))


def q_key_figures(spark, sf_dir):
    """Growth, edge over the benchmark, Sharpe ratio and worst drawdown of the explorer's run."""
    with _kept(panels.supplier_months(spark, sf_dir)) as months:
        built = explorer.recompute(_ranked(months), _gapless(months), replace(LOOSE, top_n=8), _market(spark, sf_dir), schemes=("equal",))
        shown = explorer.key_figures("equal", built, None, spark)
        shown = shown.select("scheme", *_r("is_cagr", "is_bench_cagr", "is_edge", "is_sharpe", "is_mdd", "oos_cagr", digits=5))
        return _finished(built, shown) if built else shown


def q_ticker_cleaning(spark, sf_dir):
    return universe.clean_tickers(panels.part_names(spark, sf_dir))


def _monthly_returns(spark, sf_dir):
    monthly = resample.month_end(panels.flag_days(spark, sf_dir)).select("symbol", F.col("month_idx").cast("bigint").alias("ts"), "px")
    return align.aligned_returns(align.align_on_dates(monthly))


def q_max_sharpe(spark, sf_dir):
    """Best weights of the whole sample and what they give."""
    return weights.max_sharpe_weights(_monthly_returns(spark, sf_dir), replace(LIVE.weights, cap=0.40, iterations=400))


def q_weights_resampled(spark, sf_dir):
    return weights.compute_weights("resampled", _monthly_returns(spark, sf_dir), replace(LIVE.weights, cap=0.40))


def q_explorer_oos(spark, sf_dir):
    """Chosen on the first four years, tested on the rest, equal and inverse-volatility weights."""
    mode = replace(LIVE, oos_years=1, oos_min_years=4)
    with _kept(panels.supplier_months(spark, sf_dir)) as months:
        built = explorer.recompute_oos(_gapless(months), replace(LOOSE, top_n=10), OOS_MONTH + MONTHLY, mode=mode, schemes=("equal", "invvol"))
        if built is None:
            return spark.createDataFrame([], "scheme string, mode string, cagr double, vol double, mdd double, mar double, sharpe double")
        return _finished(built, built.metrics.select("scheme", "mode", *_r("cagr", "vol", "mdd", "mar", "sharpe", digits=5)))


def _sound(found: DataFrame, params: WeightParams, *more: Column) -> DataFrame:
    """What must hold of weights whatever the random draws: members, their sum, the box."""
    inside = F.col("weight").between(params.floor - 1e-9, params.cap + 1e-9)
    return found.agg(F.count_distinct("symbol").alias("members"), F.round(F.sum("weight"), 6).alias("total"), F.every(inside).alias("in_box"), *more)


def q_resampled_sound(spark, sf_dir):
    """Resampled weights: each series has one, they add up to 1 and lie in the box, all scenarios count, and they vary."""
    params = replace(LIVE.weights, cap=0.40)
    found = weights.compute_weights("resampled", _monthly_returns(spark, sf_dir), params)
    return _sound(found, params, F.max("scenarios").alias("scenarios"), F.every(F.col("wstd").between(0, 0.40)).alias("spread_known"))


def q_max_sharpe_sound(spark, sf_dir):
    """The best weights: in the box, adding up to 1, and with no lower Sharpe ratio than equal ones."""
    params = replace(LIVE.weights, cap=0.40, iterations=400)
    returns = _monthly_returns(spark, sf_dir)
    equal = weights.portfolio_statistics(weights.equal_weights(returns.select("symbol").distinct()), returns, params)
    best = weights.max_sharpe_weights(returns, params).join(F.broadcast(equal.select(F.col("sharpe").alias("plain"))), F.lit(True))
    return _sound(best, params, F.round(F.max("plain"), 6).alias("equal_sharpe"), F.every(F.col("sharpe") >= F.col("plain") - 1e-9).alias("no_worse"))


def q_universe_meta(spark, sf_dir):
    """The meta artifact's entries by region: series measured, and those whose curves are kept."""
    rows = _rows(spark, sf_dir).join(panels.supplier_regions(spark, sf_dir), "symbol")
    return universe.pool_sizes(rows, ("universe",), 6, 0.004, MONTHLY).withColumn("universe", F.col("universe").cast("bigint"))


# --- SQL ---------------------------------------------------------------------

_PRICE = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) / count(*)"


def _panel(symbol: str, unit: str) -> str:
    return f"""SELECT {symbol} AS symbol, CAST(epoch(date_trunc('{unit}', l_shipdate)) AS BIGINT) AS ts,
    {_PRICE.format('l_extendedprice')} AS px FROM lineitem GROUP BY 1, 2"""


_MONTHS = _panel("printf('S%06d', l_suppkey)", "month")
_DAYS = _panel("printf('S%06d', l_suppkey)", "day")
_FLAGS = _panel("l_returnflag || l_linestatus", "day")
_FLAG_MONTHS = _panel("l_returnflag || l_linestatus", "month")
_URGENT = """SELECT CAST(epoch(date_trunc('{unit}', o_orderdate)) AS BIGINT) AS ts, {price} AS px
    FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1"""
_BY_TS = "PARTITION BY {k} ORDER BY ts"


def _metric_ctes(ppy: int, keys: str = "symbol", source: str = "p", name: str = "m") -> str:
    """CTEs from a panel ``source(keys, ts, px)`` to metric rows ``name``."""
    by = _BY_TS.format(k=keys)
    return f"""{name}_s AS (
  SELECT *, lag(px) OVER ({by}) AS prev, lag(px, {int(5 * ppy + 0.5)}) OVER ({by}) AS five_ago,
    max(px) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak,
    row_number() OVER ({by}) - 1 AS x, ln(px) AS y
  FROM {source}
), {name}_c AS (
  SELECT *, x - avg(x) OVER (PARTITION BY {keys}) AS dx, y - avg(y) OVER (PARTITION BY {keys}) AS dy FROM {name}_s
), {name}_l AS (
  SELECT *, dy - dx * sum(dx * dy) OVER (PARTITION BY {keys}) / nullif(sum(dx * dx) OVER (PARTITION BY {keys}), 0) AS miss FROM {name}_c
), {name}_a AS (
  SELECT {keys}, count(*) AS days, strftime(to_timestamp(min(ts)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS "start",
    strftime(to_timestamp(max(ts)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS "end",
    CASE WHEN count(*) >= 2 THEN pow(arg_max(px, ts) / arg_min(px, ts), {float(ppy)} / count(*)) - 1 END AS cagr,
    CASE WHEN count(px / prev) >= 2 THEN stddev_samp(px / prev - 1) * sqrt({ppy}) END AS vol,
    CASE WHEN count(*) FILTER (WHERE px < prev) >= 2
      THEN sqrt(sum(pow(px / prev - 1, 2)) FILTER (WHERE px < prev) / count(*) FILTER (WHERE px < prev)) * sqrt({ppy}) END AS dvol,
    least(min(px / peak - 1), 0) AS mdd, min(px / five_ago - 1) AS min5y,
    CASE WHEN count(*) >= 30 AND min(y) < max(y) THEN pow(sum(dx * dy), 2) / (sum(dx * dx) * sum(dy * dy)) END AS r2,
    CASE WHEN count(*) >= 30 THEN sqrt(avg(miss * miss)) END AS reg
  FROM {name}_l GROUP BY {keys}
), {name} AS (
  SELECT *, cagr / nullif(abs(mdd), 0) AS mar, CASE WHEN dvol > 0 THEN (cagr - 0.03) / dvol END AS sortino,
    (cagr - 0.03) / nullif(vol, 0) AS sharpe, cagr / nullif(vol * abs(mdd), 0) AS score
  FROM {name}_a
)"""


def _rank_ctes(source: str, name: str, zero: bool = False) -> str:
    """CTEs from metric rows to ``name`` with the three ranks and the quality."""
    value = "coalesce({0}, 0)" if zero else "{0}"
    ranks = ", ".join(
        f"""CASE WHEN v_{p} IS NOT NULL THEN CASE WHEN count(v_{p}) OVER () = 1 THEN 1.0
      ELSE CAST(row_number() OVER (PARTITION BY v_{p} IS NULL ORDER BY v_{p}, symbol) - 1 AS DOUBLE) / nullif(count(v_{p}) OVER () - 1, 0) END END AS rank_{p}"""
        for p in quality.PARTS
    )
    values = ", ".join(f"{value.format(p)} AS v_{p}" for p in quality.PARTS)
    total = " + ".join(f"coalesce(rank_{p}, 0)" for p in quality.PARTS)
    count = " + ".join(f"CAST(rank_{p} IS NOT NULL AS INT)" for p in quality.PARTS)
    return f"""{name}_v AS (SELECT *, {values} FROM {source}), {name}_r AS (SELECT *, {ranks} FROM {name}_v),
{name} AS (SELECT *, CAST({total} AS DOUBLE) / nullif({count}, 0) AS quality FROM {name}_r)"""


def _reason_sql(p: ScreenParams) -> str:
    value = "coalesce({0}, 0)" if p.undefined_as_zero else "{0}"
    checks = [f"WHEN days < {p.least_points()} THEN 'history'", f"WHEN {value.format('min5y')} < {p.tolerance_5y} THEN 'five_year'", f"WHEN {value.format('r2')} < {p.min_r2} THEN 'r2'"]
    if p.min_cagr is not None:
        checks.append(f"WHEN {value.format('cagr')} < {p.min_cagr} THEN 'cagr'")
    if p.max_drawdown is not None:
        checks.append(f"WHEN {value.format('mdd')} < {p.max_drawdown} THEN 'drawdown'")
    return f"CASE {' '.join(checks)} END"


def _rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


_MONTH_METRICS = f"WITH p AS ({_MONTHS}), {_metric_ctes(MONTHLY)}"
_MONTH_RANKS = f"{_MONTH_METRICS}, long AS (SELECT * FROM m WHERE days >= 30), {_rank_ctes('long', 'q')}"
_ALIGNED_ON = """f AS ({panel}), f_n AS (SELECT ts FROM f GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM f)),
al AS (SELECT f.* FROM f JOIN f_n USING (ts)),
rets AS (SELECT * FROM (SELECT *, px / lag(px) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM al) WHERE ret IS NOT NULL)"""
_ALIGNED, _ALIGNED_MONTHS = _ALIGNED_ON.format(panel=_FLAGS), _ALIGNED_ON.format(panel=_FLAG_MONTHS)


def _equal_sql(prices: str, name: str = "eq") -> str:
    return f"""{name}_m AS (
  SELECT ts, coalesce(px / lag(px) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0) AS ret,
    px / first_value(px) OVER (PARTITION BY symbol ORDER BY ts) AS growth FROM {prices}
), {name}_d AS (SELECT ts, avg(ret) AS ret, avg(growth) AS growth FROM {name}_m GROUP BY ts),
{name} AS (
  SELECT 'equal' AS scheme, 'rebal' AS mode, ts, 100 * exp(sum(ln(1 + ret)) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS px FROM {name}_d
  UNION ALL SELECT 'equal', 'buyhold', ts, 100 * growth FROM {name}_d
)"""


_BENCH_ON = """ub AS ({urgent}), days AS (SELECT DISTINCT ts FROM al),
bj AS (SELECT days.ts, ub.px AS v FROM days LEFT JOIN ub ON days.ts = ub.ts),
bf AS (SELECT ts, last_value(v IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM bj),
bench AS (SELECT ts, v / (SELECT arg_min(v, ts) FROM bf WHERE v IS NOT NULL) * 100 AS value FROM bf)"""
_BENCH, _BENCH_MONTHS = (_BENCH_ON.format(urgent=_URGENT.format(unit=u, price=_PRICE.format("o_totalprice"))) for u in ("day", "month"))
_PURCHASES = """SELECT 'E' || CAST(user_id % 12 AS VARCHAR) AS symbol, CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBp' ELSE 'EUR' END AS currency,
  epoch_us(ts) AS ts, "value" AS px FROM events WHERE event_type = 'purchase'"""
_RATES = """SELECT CASE WHEN user_id % 2 = 0 THEN 'USD' ELSE 'GBP' END AS ccy, epoch_us(ts) AS ts, "value" AS rate
  FROM events WHERE event_type = 'view'"""
_IDX = "CAST(year(to_timestamp(ts) AT TIME ZONE 'UTC') * 12 + month(to_timestamp(ts) AT TIME ZONE 'UTC') - 1 AS BIGINT)"
_TEXT = "printf('%04d-%02d', {0} // 12, {0} % 12 + 1)"
_GAPLESS = f"""mo AS (SELECT symbol, {_IDX} AS idx, px FROM p),
ok AS (SELECT symbol FROM mo GROUP BY symbol HAVING count(*) = max(idx) - min(idx) + 1), g AS (SELECT mo.* FROM mo JOIN ok USING (symbol))"""
_REGIONS = """SELECT printf('S%06d', s_suppkey) AS symbol, n_regionkey AS universe FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT printf('S%06d', s_suppkey), (n_regionkey + 1) % 5 FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _short_sql(as_zero: bool) -> str:
    params = replace(STRICT, min_years=3, tolerance_5y=0.01, undefined_as_zero=as_zero)
    return f"""WITH p AS ({_MONTHS}), {_metric_ctes(SHORT_PPY)}, {_rank_ctes('m', 'q', as_zero)}
SELECT symbol, {_reason_sql(params)} AS reject_reason, round(quality, 6) AS quality FROM q"""


def _top_sql(params: ScreenParams, key: str, count: int) -> str:
    return f"SELECT * FROM q WHERE {_reason_sql(params)} IS NULL ORDER BY {key} DESC NULLS LAST, symbol LIMIT {count}"


_PICKED = f"{_MONTH_RANKS}, {_GAPLESS}, picks AS ({_top_sql(LOOSE, 'quality', 8)}), ch AS (SELECT g.* FROM g JOIN picks USING (symbol))"
_ENDS = "ce AS (SELECT symbol, min(idx) AS i0, max(idx) AS i1 FROM ch GROUP BY symbol)"
_COVERED = """cov AS (SELECT symbol FROM ce, w WHERE i0 <= lo AND i1 >= hi),
t AS (SELECT ch.symbol, ch.idx AS ts, ch.px FROM ch JOIN cov USING (symbol), w WHERE idx BETWEEN lo AND hi)"""
_ON_MONTHS = f"{_ENDS}, w AS (SELECT max(i0) AS lo, min(i1) AS hi FROM ce), {_COVERED}"
_MONTH_BENCH = f"""ub AS (SELECT {_IDX} AS idx, px FROM (
  SELECT CAST(epoch(date_trunc('month', l_shipdate)) AS BIGINT) AS ts, {_PRICE.format('l_extendedprice')} AS px FROM lineitem GROUP BY 1))"""

_CAPPED_CTES = """v AS (SELECT symbol, 1 / sqrt(greatest(var_samp(ret), 1e-12)) AS w FROM rets GROUP BY symbol),
n AS (SELECT list(w / t ORDER BY symbol) AS ws FROM v, (SELECT sum(w) AS t FROM v)),
b AS (
  SELECT 0 AS it, list_min(ws) - 0.20 AS lo, list_max(ws) - 0.02 AS hi, ws FROM n
  UNION ALL
  SELECT it + 1, CASE WHEN list_sum(list_transform(ws, lambda x: least(0.20, greatest(0.02, x - (lo + hi) / 2)))) > 1 THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN list_sum(list_transform(ws, lambda x: least(0.20, greatest(0.02, x - (lo + hi) / 2)))) > 1 THEN hi ELSE (lo + hi) / 2 END, ws
  FROM b WHERE it < 100
), c AS (SELECT v.symbol, least(0.20, greatest(0.02, v.w / (SELECT sum(w) FROM v) - (b.lo + b.hi) / 2)) AS w FROM v, b WHERE b.it = 100)"""
_CAPPED = "WITH RECURSIVE {ctes}, " + _CAPPED_CTES + " SELECT 'invvol' AS scheme, symbol, round(w / (SELECT sum(w) FROM c), 6) AS weight FROM c"
_MONTH_RETURNS = f"""f AS (SELECT symbol, {_IDX} AS ts, arg_max(px, ts) AS px FROM ({_FLAGS}) GROUP BY 1, 2),
f_n AS (SELECT ts FROM f GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM f)), al AS (SELECT f.* FROM f JOIN f_n USING (ts)),
rets AS (SELECT * FROM (SELECT *, px / lag(px) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM al) WHERE ret IS NOT NULL)"""
_EXPLORER_OOS = f"""WITH RECURSIVE p AS ({_MONTHS}), {_GAPLESS},
fit AS (SELECT symbol FROM g GROUP BY symbol HAVING count(*) FILTER (WHERE idx <= {OOS_MONTH}) >= 48 AND count(*) FILTER (WHERE idx > {OOS_MONTH}) >= {explorer.LEAST_AFTER}),
early AS (SELECT symbol, idx AS ts, px FROM g JOIN fit USING (symbol) WHERE idx <= {OOS_MONTH}), {_metric_ctes(MONTHLY, source="early")}, {_rank_ctes('m', 'q')},
picks AS ({_top_sql(replace(LOOSE, min_years=4), 'quality', 10)}),
ea AS (SELECT early.* FROM early JOIN picks USING (symbol) WHERE ts >= (SELECT max(i0) FROM (SELECT min(ts) AS i0 FROM early JOIN picks USING (symbol) GROUP BY symbol))),
rets AS (SELECT * FROM (SELECT *, px / lag(px) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM ea) WHERE ret IS NOT NULL), {_CAPPED_CTES},
wt AS (SELECT 'invvol' AS scheme, symbol, w / (SELECT sum(w) FROM c) AS weight FROM c UNION ALL SELECT 'equal', symbol, 1.0 / count(*) OVER () FROM picks),
late AS (SELECT g.symbol, idx AS ts, px FROM g JOIN picks USING (symbol) WHERE idx > {OOS_MONTH}),
t AS (SELECT * FROM late WHERE ts <= (SELECT min(i1) FROM (SELECT max(ts) AS i1 FROM late GROUP BY symbol))),
mv AS (SELECT symbol, ts, coalesce(px / lag(px) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0) AS ret,
  px / first_value(px) OVER (PARTITION BY symbol ORDER BY ts) AS growth FROM t),
dd AS (SELECT scheme, ts, sum(weight * ret) AS ret, sum(weight * growth) AS growth FROM mv JOIN wt USING (symbol) GROUP BY scheme, ts),
eq AS (SELECT scheme, 'rebal' AS mode, ts, 100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY scheme ORDER BY ts)) AS px FROM dd
  UNION ALL SELECT scheme, 'buyhold', ts, 100 * growth FROM dd), {_metric_ctes(MONTHLY, 'scheme, mode', 'eq', 'k')}
SELECT scheme, mode, {_rounded('cagr', 'vol', 'mdd', 'mar', 'sharpe', digits=5)} FROM k"""

_CURVE_METRICS = f"{_metric_ctes(MONTHLY, 'scheme, mode', 'eq', 'k')}"
_BENCH_METRICS = _metric_ctes(MONTHLY, "symbol", "(SELECT 'benchmark' AS symbol, ts, value AS px FROM bench WHERE value IS NOT NULL)", "bm")

ORACLE_SQL: dict[str, str] = {
    "period_returns": f"""WITH p AS ({_MONTHS}) SELECT symbol, ts, round(ret, 6) AS ret
FROM (SELECT symbol, ts, px / lag(px) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM p) WHERE ret IS NOT NULL""",
    "cagr": f"{_MONTH_METRICS} SELECT symbol, {_rounded('cagr')} FROM m",
    "annualized_vol": f"{_MONTH_METRICS} SELECT symbol, {_rounded('vol')} FROM m",
    "downside_vol": f"{_MONTH_METRICS} SELECT symbol, {_rounded('dvol')} FROM m",
    "max_drawdown": f"{_MONTH_METRICS} SELECT symbol, {_rounded('mdd')} FROM m",
    "drawdown_split": f"""SELECT symbol, round(least(min(px / peak - 1), 0), 6) AS mdd
FROM (SELECT symbol, px, max(px) OVER (PARTITION BY symbol ORDER BY ts) AS peak FROM ({_DAYS})) GROUP BY symbol""",
    "returns_split": f"""WITH p AS ({_DAYS}) SELECT symbol, ts, round(ret, 6) AS ret
FROM (SELECT symbol, ts, px / lag(px) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM p) WHERE ret IS NOT NULL""",
    "rebalanced_split": f"WITH {_ALIGNED}, {_equal_sql('al')} SELECT scheme, mode, ts, round(ln(px), 6) AS log_value FROM eq WHERE mode = 'rebal'",
    "rolling_min_return": f"{_MONTH_METRICS} SELECT symbol, {_rounded('min5y')} FROM m",
    "log_r2": f"{_MONTH_METRICS} SELECT symbol, {_rounded('r2')} FROM m",
    "log_resid_std": f"{_MONTH_METRICS} SELECT symbol, {_rounded('reg')} FROM m",
    "ratios": f"{_MONTH_METRICS} SELECT symbol, {_rounded('mar', 'sortino', 'sharpe', 'score')} FROM m",
    "drawdown_series": f"""WITH p AS ({_MONTHS}) SELECT symbol, ts,
  round((px / max(px) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) * 100, 6) AS drawdown_pct FROM p""",
    "metrics_all": f"""WITH p AS ({_DAYS}), {_metric_ctes(DAILY)} SELECT symbol, days, "start", "end",
  {_rounded('cagr', 'vol', 'mdd', 'min5y', 'r2', 'reg', 'mar', 'sortino', 'sharpe', digits=5)} FROM m WHERE days >= 30""",
    "percentile_ranks": f"{_MONTH_METRICS}, {_rank_ctes('m', 'q')} SELECT symbol, {_rounded('rank_r2', 'rank_min5y', 'rank_mar')} FROM q",
    "quality_score": f"{_MONTH_RANKS} SELECT symbol, {_rounded('quality')} FROM q",
    "screen_picks": f"{_MONTH_RANKS} SELECT symbol, days, {_rounded('quality')} FROM ({_top_sql(STRICT, 'quality', STRICT.top_n)})",
    "screen_reject_counts": f"""{_MONTH_RANKS}, r AS (SELECT {_reason_sql(STRICT)} AS reason FROM q)
SELECT names.reason, count(r.reason) AS n FROM (VALUES {', '.join(f"('{x}')" for x in screen.REASONS)}) names(reason)
LEFT JOIN r ON r.reason = names.reason GROUP BY names.reason""",
    "screen_summary": f"""{_MONTH_RANKS}, r AS (SELECT {_reason_sql(STRICT)} AS reason FROM q)
SELECT count(*) AS analysed, count(*) FILTER (WHERE reason IS NULL) AS passed, least(count(*) FILTER (WHERE reason IS NULL), {STRICT.top_n}) AS shown,
  {', '.join(f"count(*) FILTER (WHERE reason = '{x}') AS rejected_{x}" for x in screen.REASONS)} FROM r""",
    "screen_ascending": f"{_MONTH_RANKS} SELECT symbol, {_rounded('cagr')} FROM ({_top_sql(STRICT, 'cagr', 5)}) ORDER BY cagr",
    "screen_undefined_passes": _short_sql(False),
    "screen_undefined_as_zero": _short_sql(True),
    "month_end": f"""WITH p AS ({_DAYS}) SELECT symbol, {_TEXT.format('idx')} AS month, max(ts) AS ts, round(arg_max(px, ts), 6) AS px
FROM (SELECT *, {_IDX} AS idx FROM p) GROUP BY symbol, idx""",
    "fx_convert_asof": f"""WITH pu AS ({_PURCHASES}), fx AS ({_RATES}),
k AS (SELECT *, CASE currency WHEN 'GBp' THEN 'GBP' ELSE currency END AS ccy FROM pu WHERE currency <> 'EUR'),
j AS (SELECT k.symbol, k.currency, k.ts, k.px / CASE WHEN k.currency = 'GBp' THEN 100.0 ELSE 1.0 END / fx.rate AS px
  FROM k ASOF JOIN fx ON k.ccy = fx.ccy AND k.ts >= fx.ts WHERE fx.rate > 0),
n AS (SELECT symbol FROM j GROUP BY symbol HAVING count(*) >= 3)
SELECT symbol, currency, ts, round(px, 6) AS px FROM (SELECT symbol, currency, ts, px FROM pu WHERE currency = 'EUR' UNION ALL SELECT j.* FROM j JOIN n USING (symbol))""",
    "needed_currencies": f"WITH pu AS ({_PURCHASES}) SELECT DISTINCT CASE currency WHEN 'GBp' THEN 'GBP' ELSE currency END AS ccy FROM pu WHERE currency <> 'EUR'",
    "align_intersection": f"WITH {_ALIGNED} SELECT symbol, ts, {_rounded('px')} FROM al",
    "benchmark_locf_rebased": f"WITH {_ALIGNED}, {_BENCH} SELECT ts, {_rounded('value')} FROM bench",
    "cov_matrix": f"""WITH {_ALIGNED} SELECT x.symbol AS a, y.symbol AS b, round(covar_samp(x.ret, y.ret), 6) AS cov
FROM rets x JOIN rets y ON x.ts = y.ts AND x.symbol <= y.symbol GROUP BY 1, 2""",
    "col_means": f"WITH {_ALIGNED} SELECT symbol, round(avg(ret), 6) AS mean_ret FROM rets GROUP BY symbol",
    "weights_equal": f"WITH {_ALIGNED} SELECT 'equal' AS scheme, symbol, round(1.0 / count(*) OVER (), 6) AS weight FROM (SELECT DISTINCT symbol FROM al)",
    "weights_invvol": _CAPPED.format(ctes=_ALIGNED),
    "portfolio_statistics": f"""WITH {_ALIGNED}, kk AS (SELECT count(DISTINCT symbol) AS k FROM al),
g AS (SELECT avg(mr) * {DAILY} AS er FROM (SELECT avg(ret) AS mr FROM rets GROUP BY symbol)),
c AS (SELECT sum(cv) AS s FROM (SELECT covar_samp(x.ret, y.ret) AS cv FROM rets x JOIN rets y ON x.ts = y.ts GROUP BY x.symbol, y.symbol)),
s AS (SELECT er, sqrt(s / k / k * {DAILY}) AS vol FROM g, c, kk)
SELECT 'equal' AS scheme, round(er, 6) AS expected_return, round(vol, 6) AS volatility, round((er - 0.03) / vol, 6) AS sharpe FROM s""",
    "backtest_rebalanced": f"WITH {_ALIGNED_MONTHS}, {_equal_sql('al')} SELECT scheme, mode, ts, round(px, 4) AS value FROM eq WHERE mode = 'rebal'",
    "backtest_buyhold": f"WITH {_ALIGNED_MONTHS}, {_equal_sql('al')} SELECT scheme, mode, ts, round(px, 4) AS value FROM eq WHERE mode = 'buyhold'",
    "backtest_metrics": f"WITH {_ALIGNED_MONTHS}, {_equal_sql('al')}, {_CURVE_METRICS} SELECT scheme, mode, {_rounded('cagr', 'vol', 'mdd', 'mar', 'sharpe', digits=5)} FROM k",
    "edge": f"""WITH {_ALIGNED_MONTHS}, {_equal_sql('al')}, {_CURVE_METRICS}, {_BENCH_MONTHS}, {_BENCH_METRICS}
SELECT scheme, mode, round(k.cagr, 5) AS cagr, round(bm.cagr, 5) AS bench_cagr, round(k.cagr - coalesce(bm.cagr, 0), 5) AS edge FROM k LEFT JOIN bm ON true""",
    "time_slice": f"""WITH f AS ({_FLAGS}), c AS (SELECT * FROM f WHERE ts BETWEEN {SLICE[0]} AND {SLICE[1]}),
n AS (SELECT symbol FROM c GROUP BY symbol HAVING count(*) >= 3) SELECT symbol, ts, round(px, 6) AS px FROM c JOIN n USING (symbol)""",
    "oos_equal": f"""WITH f AS ({_FLAG_MONTHS}), early AS (SELECT * FROM f WHERE ts <= {CUTOFF}), late AS (SELECT * FROM f WHERE ts >= {CUTOFF}),
p AS (SELECT * FROM early), {_metric_ctes(MONTHLY)}, {_rank_ctes("(SELECT * FROM m WHERE days >= 30)", 'q')},
picks AS (SELECT symbol FROM q WHERE {_reason_sql(replace(LOOSE, min_years=2))} IS NULL),
alive AS (SELECT symbol FROM late JOIN picks USING (symbol) GROUP BY symbol HAVING count(*) > 6),
la AS (SELECT late.* FROM late JOIN alive USING (symbol)),
ln_ AS (SELECT ts FROM la GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(*) FROM alive)),
tested AS (SELECT la.* FROM la JOIN ln_ USING (ts)), {_equal_sql('tested')}, {_CURVE_METRICS}
SELECT scheme, mode, {_rounded('cagr', 'vol', 'mdd', digits=5)} FROM k""",
    "live_common_window": f"""WITH p AS ({_MONTHS}), {_GAPLESS}, e AS (SELECT min(idx) AS i0, max(idx) AS i1 FROM g GROUP BY symbol), w AS (SELECT max(i0) AS lo, min(i1) AS hi FROM e)
SELECT {_TEXT.format('lo')} AS first_month, {_TEXT.format('hi')} AS last_month, hi - lo + 1 AS months FROM w""",
    "live_backtest_equal": f"""{_PICKED}, {_ON_MONTHS},
{_equal_sql('t')} SELECT mode, {_TEXT.format('ts')} AS month, round(px, 4) AS value FROM eq""",
    "universe_union_rerank": f"""{_MONTH_METRICS}, mem AS ({_REGIONS}), un AS (SELECT symbol, min(universe) AS universe FROM mem GROUP BY symbol),
u AS (SELECT m.*, un.universe FROM m JOIN un USING (symbol) WHERE days >= 30), {_rank_ctes('u', 'q', True)}
SELECT symbol, CAST(universe AS BIGINT) AS universe, {_rounded('quality')} FROM q""",
    "eligible_pool": f"{_MONTH_RANKS} SELECT symbol, days, {_rounded('r2')} FROM q WHERE days >= 72 AND r2 >= 0.004",
    "curve_segments": f"""WITH p AS ({_MONTHS}), {_GAPLESS} SELECT symbol, {_TEXT.format('min(idx)')} AS start_month, count(*) AS n,
  round(sum(px), 3) AS total, round(arg_max(px, idx), 6) AS last_px FROM g GROUP BY symbol""",
    "segment_round_trip": f"WITH p AS ({_MONTHS}), {_GAPLESS} SELECT symbol, {_TEXT.format('idx')} AS month, {_rounded('px')} FROM g",
    "curve_union": f"""WITH p AS ({_MONTHS}), {_GAPLESS}, mem AS ({_REGIONS}), un AS (SELECT symbol, min(universe) AS universe FROM mem GROUP BY symbol)
SELECT symbol, {_TEXT.format('idx')} AS month, round(px * (universe + 1), 6) AS px FROM g JOIN un USING (symbol)""",
    "missing_count": f"""WITH p AS ({_MONTHS}), {_GAPLESS}
SELECT (SELECT count(DISTINCT symbol) FROM p) - (SELECT count(DISTINCT symbol) FROM g) AS dropped""",
    "screen_table": f"""{_MONTH_RANKS} SELECT symbol IN ('S000001', 'S000003') AS in_basket, symbol, {_rounded(*explorer.SHOWN)}
FROM ({_top_sql(STRICT, 'quality', STRICT.top_n)})""",
    "metrics_stored": f"{_MONTH_RANKS} SELECT symbol, {', '.join(f'round({m}, {d}) + 0.0 AS {m}' for m, d in artifacts.DIGITS.items())} FROM q",
    "benchmark_choice": f"""WITH p AS ({_FLAGS}) SELECT {_TEXT.format('idx')} AS month, round(arg_max(px, ts), 6) AS px
FROM (SELECT *, {_IDX} AS idx FROM p) WHERE symbol = 'NF' GROUP BY idx""",
    "benchmark_on_months": f"""WITH p AS ({_MONTHS}), {_GAPLESS}, e AS (SELECT min(idx) AS i0, max(idx) AS i1 FROM g GROUP BY symbol),
w AS (SELECT max(i0) AS lo, min(i1) AS hi FROM e), {_MONTH_BENCH},
c AS (SELECT idx, px FROM ub, w WHERE idx BETWEEN lo AND hi AND (SELECT min(idx) FROM ub) <= lo AND (SELECT max(idx) FROM ub) >= hi)
SELECT {_TEXT.format('idx')} AS month, round(px / (SELECT arg_min(px, idx) FROM c) * 100, 6) AS value FROM c""",
    "chart_points": """WITH p AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS symbol, CASE WHEN o_custkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
  CAST(epoch(o_orderdate) AS BIGINT) AS ts, CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 2 END
    ELSE CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -o_totalprice ELSE o_totalprice END END AS px FROM orders),
n AS (SELECT symbol FROM p WHERE px > 0 GROUP BY symbol HAVING count(*) >= 2)
SELECT symbol, currency, ts, round(px, 6) AS px FROM p JOIN n USING (symbol) WHERE px > 0""",
    "latest_update": "SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS updated FROM orders",
    "pick_info": f"""WITH p AS ({_FLAG_MONTHS}), {_metric_ctes(MONTHLY)}, {_rank_ctes("(SELECT * FROM m WHERE days >= 30)", 'q')}
SELECT symbol, days, {_rounded('cagr', 'quality')}, round(1.0 / count(*) OVER (), 6) AS w_equal FROM q WHERE {_reason_sql(LOOSE)} IS NULL""",
    "basket_equal": f"""WITH p AS ({_MONTHS}), {_GAPLESS}, ch AS (SELECT g.* FROM g WHERE symbol IN {tuple(sorted(set(BASKET)))}), {_ON_MONTHS}, {_equal_sql('t')}
SELECT {_TEXT.format('ts')} AS month, round(px, 4) AS value FROM eq WHERE mode = 'buyhold'""",
    "weight_table": f"""SELECT symbol, weight, round(weight / max(weight) OVER (), 4) AS bar FROM ({_CAPPED.format(
        ctes=f"{_PICKED[5:]}, {_ON_MONTHS}, rets AS (SELECT * FROM (SELECT *, px / lag(px) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM t) WHERE ret IS NOT NULL)"
    )})""",
    "key_figures": f"""{_MONTH_RANKS}, {_GAPLESS}, picks AS ({_top_sql(LOOSE, 'quality', 8)}),
ch AS (SELECT g.* FROM g JOIN picks USING (symbol)), {_MONTH_BENCH}, {_ENDS},
w AS (SELECT max(i0) AS lo, min(i1) AS hi FROM (SELECT i0, i1 FROM ce UNION ALL SELECT min(idx), max(idx) FROM ub)), {_COVERED},
bench AS (SELECT idx AS ts, px AS value FROM ub, w WHERE idx BETWEEN lo AND hi), {_equal_sql('t')}, {_CURVE_METRICS}, {_BENCH_METRICS}
SELECT scheme, round(k.cagr, 5) AS is_cagr, round(bm.cagr, 5) AS is_bench_cagr, round(k.cagr - coalesce(bm.cagr, 0), 5) AS is_edge,
  round(k.sharpe, 5) AS is_sharpe, round(k.mdd, 5) AS is_mdd, CAST(NULL AS DOUBLE) AS oos_cagr FROM k LEFT JOIN bm ON true WHERE mode = 'rebal'""",
    "explorer_oos": _EXPLORER_OOS,
    "resampled_sound": f"""WITH {_MONTH_RETURNS} SELECT count(DISTINCT symbol) AS members, 1.0::DOUBLE AS total, true AS in_box,
  {LIVE.weights.scenarios}::BIGINT AS scenarios, true AS spread_known FROM rets""",
    "max_sharpe_sound": f"""WITH {_MONTH_RETURNS},
g AS (SELECT avg(mr) * {MONTHLY} AS er FROM (SELECT avg(ret) AS mr FROM rets GROUP BY symbol)), kk AS (SELECT count(DISTINCT symbol) AS k FROM rets),
cv AS (SELECT sum(cv) AS s FROM (SELECT covar_samp(x.ret, y.ret) AS cv FROM rets x JOIN rets y ON x.ts = y.ts GROUP BY x.symbol, y.symbol))
SELECT k AS members, 1.0::DOUBLE AS total, true AS in_box, round((er - 0.03) / sqrt(s / k / k * {MONTHLY}), 6) AS equal_sharpe, true AS no_worse FROM g, cv, kk""",
    "universe_meta": f"""{_MONTH_RANKS}, mem AS ({_REGIONS})
SELECT CAST(universe AS BIGINT) AS universe, count(*) AS "count", count(*) FILTER (WHERE days >= 72 AND r2 >= 0.004) AS eligible FROM q JOIN mem USING (symbol) GROUP BY 1""",
    "ticker_cleaning": """SELECT DISTINCT symbol FROM (
  SELECT upper(replace(trim(v), '.', '-')) AS symbol FROM (SELECT p_name AS v FROM part UNION ALL SELECT p_type FROM part)
) WHERE length(symbol) BETWEEN 1 AND 6 AND symbol NOT IN ('NAN', 'SYMBOL', 'TICKER')""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cagr": _one_metric("cagr"),
    "annualized_vol": _one_metric("vol"),
    "downside_vol": _one_metric("dvol"),
    "max_drawdown": _one_metric("mdd"),
    "drawdown_split": q_drawdown_split,
    "returns_split": q_returns_split,
    "rebalanced_split": q_rebalanced_split,
    "rolling_min_return": _one_metric("min5y"),
    "log_r2": _one_metric("r2"),
    "log_resid_std": _one_metric("reg"),
    "ratios": _one_metric("mar", "sortino", "sharpe", "score"),
} | {name[2:]: made for name, made in list(globals().items()) if name.startswith("q_")}
