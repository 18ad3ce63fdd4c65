"""Writers of the metric, curve, portfolio, benchmark and meta artifacts.

Wide tables go out as Parquet by universe. A JSON artifact is a folder of documents of
about ``PIECE`` series each, one for a screen of a few thousand, so any number of
series can be written and no task holds more than a document.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from ..functions.columns import defined, fixed, month_text
from ..operators.resample import month_end, to_segments
from ..operators.screen import REASONS, screen_summary
from ..params import SCHEMES, ScreenParams, Universe
from ..plans.portfolio import Backtest, OutOfSample, Portfolio
from ..sources.artifacts import read_meta_of
from ..versions import change

# Digits of the stored metrics.
DIGITS = {m: 4 for m in "cagr vol mdd min5y r2 reg quality".split()} | {m: 3 for m in "mar sortino sharpe score".split()}
PIECE = 10_000


def _in_pieces(rows: DataFrame, count: int) -> GroupedData:
    """``rows`` grouped for documents of about ``PIECE`` rows; a single one, even of no rows, if that is enough."""
    pieces = -(-count // PIECE)
    return rows.groupBy(F.pmod(F.xxhash64("symbol"), F.lit(pieces)).alias("piece")) if pieces > 1 else rows.groupBy()


def _write(documents: DataFrame, path: str) -> None:
    """Documents one a file, as a reader takes a file for one document."""
    documents.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def rounded_metrics(rows: DataFrame) -> DataFrame:
    """Metric rows as stored: rounded, undefined ones null."""
    return rows.select(*[fixed(F.col(c), DIGITS[c]).alias(c) if c in DIGITS else F.col(c) for c in rows.columns])


def write_table(rows: DataFrame, path: str, universe: str) -> None:
    """One universe's rows of a table that is partitioned by universe; the others stay."""
    tagged = rows.withColumn("universe", F.lit(universe))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("universe").parquet(path)


def _params(params: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in params.items() for x in (k, float(v))]) if params else F.lit(None).cast("map<string,double>")


def metrics_document(rows: DataFrame, universe: str, label: str, updated: str, params: dict[str, float], base: str = "EUR") -> DataFrame:
    """Rows ``value``: the metrics artifact as JSON documents, each with the count of all."""
    count = rows.count()
    names = ["ccy", "days", "start", "end", *DIGITS]
    entry = F.struct(F.col("symbol").alias("t"), *[F.col(c) for c in names if c in rows.columns])
    listed = _in_pieces(rounded_metrics(rows), count).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    header = [F.lit(updated).alias("updated"), F.lit(base).alias("base"), F.lit(universe).alias("universe"), F.lit(label).alias("label"), _params(params).alias("params")]
    whole = F.struct(*header, F.lit(count).cast("bigint").alias("count"), "rows")
    return listed.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def write_metrics(rows: DataFrame, path: str, **header) -> None:
    _write(metrics_document(rows, **header), path)


def _segments_map(segments: GroupedData, *more: str) -> DataFrame:
    value = F.struct(*more, F.col("start_month").alias("s"), F.col("p"))
    return segments.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("symbol"), value.alias("v"))))).alias("series"))


def curves_document(prices: DataFrame, updated: str, benchmark: DataFrame | None = None, base: str = "EUR") -> DataFrame:
    """Rows ``value``: month-end curves of ``prices`` as JSON documents, each with the benchmark's if there is one."""
    packed = _segments_map(_in_pieces(to_segments(month_end(prices)), prices.select("symbol").distinct().count()))
    fields = [F.lit(updated).alias("updated"), F.lit(base).alias("base"), F.lit("M").alias("freq"), F.col("series")]
    if benchmark is not None:
        bench = to_segments(month_end(benchmark.withColumn("symbol", F.lit("bench")))).select(F.struct(F.col("start_month").alias("s"), "p").alias("bench"))
        packed = packed.join(F.broadcast(bench), F.lit(True), "left")
        fields.append(F.col("bench"))
    return packed.select(F.to_json(F.struct(*fields)).alias("value"))


def write_curves(prices: DataFrame, path: str, updated: str, benchmark: DataFrame | None = None) -> None:
    _write(curves_document(prices, updated, benchmark), path)


def benchmarks_document(prices: DataFrame, labels: dict[str, str], updated: str, base: str = "EUR") -> DataFrame:
    """One row ``value``: the labelled benchmark curves as JSON."""
    names = prices.sparkSession.createDataFrame(list(labels.items()), "symbol string, label string")
    packed = _segments_map(to_segments(month_end(prices)).join(F.broadcast(names), "symbol").groupBy(), "label")
    return packed.select(F.to_json(F.struct(F.lit(updated).alias("updated"), F.lit(base).alias("base"), "series")).alias("value"))


CURVE_NUMBERS = ("cagr", "vol", "mdd", "mar", "sharpe")


def _numbers() -> Column:
    return F.struct(*[fixed(F.col(c), DIGITS[c]).alias(c) for c in CURVE_NUMBERS]).alias("metrics")


def _day(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")


def _month_values(curve: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, months, values)`` of ``(*keys, ts, value)``: the last value of each month, to four digits."""
    monthly = month_end(curve.select(F.lit("").alias("symbol"), *keys, "ts", F.col("value").alias("px")), ("symbol", *keys))
    points = F.array_sort(F.collect_list(F.struct("month_idx", F.round("px", 4).alias("px"))))
    packed = monthly.groupBy("symbol", *keys).agg(points.alias("points"))
    return packed.select(*keys, F.transform("points.month_idx", month_text).alias("months"), F.col("points.px").alias("values"))


def _backtest_struct(test: Backtest, name: str) -> DataFrame:
    """One row with a struct: the span, the benchmark's curve and metrics, and those of every scheme and mode."""
    curves = _month_values(test.equity, "scheme", "mode").join(test.metrics.select("scheme", "mode", _numbers()), ["scheme", "mode"])
    out = curves.agg(F.array_sort(F.collect_list(F.struct("scheme", "mode", "metrics", "months", "values"))).alias("schemes"))
    span = test.equity.agg(_day(F.min("ts")).alias("from"), _day(F.max("ts")).alias("to"))
    out = out.join(F.broadcast(span), F.lit(True))  # every table joined here is one row
    fields = ["from", "to", "schemes"]
    if test.benchmark is not None and test.benchmark_metrics is not None:
        bench = _month_values(test.benchmark.where("value is not null")).select(F.struct("months", "values").alias("bench"))
        numbers = test.benchmark_metrics.select(_numbers().alias("bench_metrics"))
        out = out.join(F.broadcast(bench), F.lit(True), "left").join(F.broadcast(numbers), F.lit(True), "left")
        fields += ["bench", "bench_metrics"]
    return out.select(F.struct(*fields).alias(name))


def _listed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``picks``: ``rows`` as structs, best quality first whatever order they come in."""
    place = F.struct((-F.coalesce(defined(F.col("quality")), F.lit(float("-inf")))).alias("k"), F.col("symbol").alias("s"))
    entry = F.struct(place.alias("place"), F.struct(*columns).alias("pick"))
    return rows.agg(F.array_sort(F.collect_list(entry)).alias("x")).select(F.col("x.pick").alias("picks"))


def portfolio_document(
    portfolio: Portfolio,
    inside: Backtest,
    outside: OutOfSample | None,
    universe: Universe,
    rows: DataFrame,
    params: ScreenParams,
    updated: str,
    oos_min_years: int = 12,
) -> DataFrame:
    """One row ``value``: what a screen of ``rows`` chose, its weights and both backtests as JSON.

    A portfolio has ``top_n`` picks and its curves a value a month, so it is one small document.
    """
    given = [F.lit(getattr(universe, f)).alias(f) for f in ("id", "label", "benchmark")]
    header = {k: v for k, v in asdict(params).items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    given[0] = given[0].alias("universe")
    info = rounded_metrics(portfolio.info())
    weights = [c for c in info.columns if c.startswith(("w_", "sd_"))]
    shown = [c for c in ("cagr", "vol", "mdd", "min5y", "r2", "reg", "mar", "quality") if c in info.columns]
    picks = _listed(info, ["symbol", *weights, *shown])
    scenarios = portfolio.weights.agg(F.max("scenarios").alias("scenarios"))
    counted = screen_summary(rows, params).select(F.struct(*[F.col(f"rejected_{r}").alias(r) for r in REASONS]).alias("skipped"), "passed")
    out = picks.join(F.broadcast(scenarios), F.lit(True)).join(F.broadcast(counted), F.lit(True)).join(_backtest_struct(inside, "backtest"), F.lit(True))
    out = out.select(F.struct("picks", "scenarios", "skipped", "passed", "backtest").alias("canonical"))
    fields = ["canonical"]
    if outside is not None:
        columns = [F.max(F.when(F.col("scheme") == s, F.col("weight"))).alias(f"w_{s}") for s in SCHEMES]
        later = outside.weights.groupBy("symbol").agg(*columns).join(outside.portfolio.picks.select("symbol", "quality"), "symbol")
        chosen = _listed(later, ["symbol", *[f"w_{s}" for s in SCHEMES]]).join(_backtest_struct(outside.backtest, "backtest"), F.lit(True))
        cutoff = _day(F.lit(outside.cutoff).cast("bigint")).alias("cutoff")
        out = out.join(chosen.select(F.struct(cutoff, F.lit(oos_min_years).alias("min_years"), "picks", "backtest").alias("oos")), F.lit(True))
        fields.append("oos")
    whole = F.struct(*given, _params(header).alias("params"), F.lit(updated).alias("updated"), *fields)
    return out.select(F.to_json(whole, {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def upsert_meta(new: DataFrame, path: str, updated: str) -> None:
    """Replace the entries ``new(universe, count, eligible, updated)`` in the meta artifact; the rest stays.

    The merged document becomes the next version in one step; of two runs at once, the
    later merges into what the first has written.
    """
    spark = new.sparkSession
    value = F.struct("count", "eligible", "updated")

    def merge(folders: list[str], to: str) -> list[str]:
        old = read_meta_of(spark, folders).join(new.select("universe"), "universe", "left_anti")
        merged = old.unionByName(new.select("universe", "count", "eligible", "updated"))
        packed = merged.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("universe", value.alias("v"))))).alias("universes"))
        packed.select(F.to_json(F.struct(F.lit(updated).alias("updated"), "universes")).alias("value")).write.text(to)
        return [to]

    change(spark, path, merge)
