"""Readers of the stored metric, curve, benchmark and meta artifacts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import from_segments
from ..schemas import BENCHMARKS_FILE, CURVES_FILE, META_FILE, METRIC_NAMES, METRICS_FILE
from ..versions import current


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows with their universe and the date of the artifact."""
    rows = _json(spark, path, METRICS_FILE).select("universe", "updated", F.posexplode("rows").alias("input_ord", "r"))
    return rows.select("universe", "updated", "input_ord", F.col("r.t").alias("symbol"), "r.ccy", "r.days", "r.start", "r.end", *[f"r.{m}" for m in METRIC_NAMES])


def stored_metrics(spark: SparkSession, folder: str, universe: str) -> DataFrame:
    """Metric rows of a universe from the Parquet table beside the documents."""
    return spark.read.parquet(f"{folder}/metrics").where(F.col("universe") == universe)


def stored_curves(spark: SparkSession, folder: str, universe: str) -> DataFrame:
    """``(symbol, month_idx, px)`` of a universe's curves from the Parquet table."""
    return from_segments(spark.read.parquet(f"{folder}/curves").where(F.col("universe") == universe).select("symbol", "start_month", "p"))


def stored_bench_curve(spark: SparkSession, folder: str, universe: str) -> DataFrame:
    """``(month_idx, px)`` of the benchmark of a universe's run, if it had one."""
    packed = spark.read.parquet(f"{folder}/bench").where(F.col("universe") == universe)
    return from_segments(packed.select("symbol", "start_month", "p")).select("month_idx", "px")


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """``(symbol, month_idx, px)`` of all curves of an artifact."""
    series = _json(spark, path, CURVES_FILE).select(F.explode("series").alias("symbol", "v"))
    return from_segments(series.select("symbol", F.col("v.s").alias("start_month"), F.col("v.p").alias("p")))


def read_bench_curve(spark: SparkSession, path: str) -> DataFrame:
    """``(month_idx, px)`` of the benchmark stored beside the curves, if any."""
    bench = _json(spark, path, CURVES_FILE).where("bench is not null").limit(1).select(F.lit("bench").alias("symbol"), F.col("bench.s").alias("start_month"), F.col("bench.p").alias("p"))
    return from_segments(bench).select("month_idx", "px")


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """``(symbol, label, month_idx, px)``; no rows if the artifact can't be read."""
    try:
        series = _json(spark, path, BENCHMARKS_FILE).select(F.explode("series").alias("symbol", "v"))
    except AnalysisException:
        return spark.createDataFrame([], "symbol string, label string, month_idx int, px double")
    flat = series.select("symbol", F.col("v.label").alias("label"), F.col("v.s").alias("start_month"), F.col("v.p").alias("p"))
    return from_segments(flat, ("symbol", "label"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """``(universe, count, eligible, updated)`` of the artifact's version now; no rows before the first."""
    return read_meta_of(spark, current(spark, path)[1])


def read_meta_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], "universe string, count bigint, eligible bigint, updated string")
    universes = _json(spark, folders[0], META_FILE).select(F.explode("universes").alias("universe", "v"))
    return universes.select("universe", "v.count", "v.eligible", "v.updated")
