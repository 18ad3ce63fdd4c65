"""Load new price files as they come, and bring what depends on them up to date.

The batch functions stay the only definition of a metric: each micro-batch adds
its points to the price table and recomputes the series it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import universe_metrics
from ..params import DAILY
from ..schemas import PRICES
from ..sources.series import usable_points

SYMBOL_BUCKETS = 64


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(SYMBOL_BUCKETS)).cast("int"))


def latest_points(prices: DataFrame) -> DataFrame:
    """One point per series and time: of several loads the last one counts."""
    return prices.groupBy("symbol", "ts").agg(F.max_by(F.struct("currency", "px"), "load").alias("p")).select("symbol", "p.currency", "ts", "p.px")


def load_prices(spark: SparkSession, incoming: str, prices: str, metrics: str, checkpoint: str, ppy: int = DAILY) -> StreamingQuery:
    """Take the price files that are new in ``incoming`` and stop.

    Points are appended to the table ``prices`` by bucket of symbol. Metric rows of
    the series in the batch are computed anew from the buckets they lie in and
    replace those buckets' rows. A batch that is run again after a failure writes the
    same load number, whose points it first finds there and then overwrites.
    """

    def take(batch: DataFrame, load: int) -> None:
        points = _bucketed(usable_points(batch)).withColumn("load", F.lit(load))
        writer = points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("load", "bucket").parquet(prices)
        touched = [r["bucket"] for r in points.select("bucket").distinct().collect()]
        stored = batch.sparkSession.read.parquet(prices).where(F.col("bucket").isin(touched))
        rows = _bucketed(universe_metrics(latest_points(stored), ppy))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(metrics)

    stream = spark.readStream.schema(PRICES).parquet(incoming)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_closes(spark: SparkSession, incoming: str, late: str = "7 days") -> DataFrame:
    """A stream of the last price of each series and day, given out once the watermark has passed the day."""
    points = usable_points(spark.readStream.schema(PRICES).parquet(incoming)).withColumn("at", F.timestamp_seconds("ts"))
    days = points.withWatermark("at", late).groupBy("symbol", F.window("at", "1 day").alias("day"))
    return days.agg(F.max_by("px", "at").alias("px")).select("symbol", F.col("day.start").alias("day"), "px")
