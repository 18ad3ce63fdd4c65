"""Price series from chart payloads and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..schemas import CHART_PAYLOAD, FX, PRICES


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Chart payloads, one JSON document per file or line, as ``prices``."""
    return payload_points(spark.read.schema(CHART_PAYLOAD).json(path))


def payload_points(payloads: DataFrame) -> DataFrame:
    """``(symbol, currency, ts, px)`` of chart payloads.

    The adjusted closes are taken if the array is there, else all plain closes;
    the two are never mixed point by point.
    """
    one = payloads.select(F.get(F.col("chart.result"), 0).alias("r")).where("r is not null")
    adjusted = F.get(F.col("r.indicators.adjclose"), 0)["adjclose"]
    plain = F.get(F.col("r.indicators.quote"), 0)["close"]
    series = one.select(
        F.col("r.meta.symbol").alias("symbol"), F.col("r.meta.currency").alias("currency"), F.col("r.timestamp").alias("t"), F.coalesce(adjusted, plain).alias("p")
    )
    points = series.select("symbol", "currency", F.inline(F.arrays_zip("t", "p"))).select("symbol", "currency", F.col("t").alias("ts"), F.col("p").alias("px"))
    return usable_series(points)


def usable_points(points: DataFrame) -> DataFrame:
    """Points with a time and a finite price above 0."""
    return points.where(F.col("ts").isNotNull() & finite(F.col("px")) & (F.col("px") > 0))


def usable_series(points: DataFrame, least: int = 2) -> DataFrame:
    """The usable points of series with ``least`` of them."""
    good = usable_points(points)
    long = good.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("symbol")
    return good.join(long, "symbol", "left_semi")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A stored price table."""
    return usable_series(spark.read.schema(PRICES).parquet(path))


def fx_symbol(ccy: str, base: str = "EUR") -> str:
    return f"{base}{ccy}=X"


def fx_of(prices: DataFrame, base: str = "EUR") -> DataFrame:
    """``(ccy, ts, rate)`` of the pair series among ``prices``."""
    pairs = prices.where(F.col("symbol").rlike(f"^{base}[A-Z]{{3}}=X$"))
    return pairs.select(F.substring("symbol", len(base) + 1, 3).alias("ccy"), "ts", F.col("px").alias("rate"))


def missing_rates(needed: DataFrame, fx: DataFrame) -> DataFrame:
    """Currencies without a rate, to warn about."""
    return needed.join(fx.select("ccy").distinct(), "ccy", "left_anti")


def read_fx(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FX).parquet(path)


def series_of(prices: DataFrame, symbols: list[str]) -> DataFrame:
    """The named series, as for benchmarks."""
    return prices.where(F.col("symbol").isin(symbols))
