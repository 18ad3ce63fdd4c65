"""Price panels from the warehouse tables, each a ``(symbol, ts, px)`` table or near it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch(day: Column) -> Column:
    return F.unix_timestamp(day.cast("timestamp")).cast("bigint")


def _mean_price(column: str) -> Column:
    """Exact mean of cents as a double."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))


def _panel(rows: DataFrame, keys: list[str], day: str, price: str, unit: str) -> DataFrame:
    """Mean price by key columns and period; names and epochs are made after the sum, once per point."""
    at = F.date_trunc(unit, F.col(day).cast("timestamp")).alias("at")
    means = rows.groupBy(*keys, at).agg(_mean_price(price).alias("px"))
    return means.withColumn("ts", _epoch(F.col("at"))).drop("at")


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean line price of each supplier and month; ``ts`` is the month's first day."""
    return _suppliers(spark, sf_dir, "month")


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean line price of each supplier and day."""
    return _suppliers(spark, sf_dir, "day")


def _suppliers(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    means = _panel(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_shipdate", "l_extendedprice", unit)
    return means.select(F.format_string("S%06d", "l_suppkey").alias("symbol"), "ts", "px")


def flag_days(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """Mean line price of each return flag with line status and day (or month): a few long series."""
    means = _panel(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_shipdate", "l_extendedprice", unit)
    return means.select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), "ts", "px")


def market_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price of all lines by month: a benchmark that covers every series."""
    return _panel(table(spark, sf_dir, "lineitem"), [], "l_shipdate", "l_extendedprice", "month").select("ts", "px")


def urgent_days(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """The benchmark: mean price of urgent orders by day (or month), with gaps."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return _panel(orders, [], "o_orderdate", "o_totalprice", unit).select("ts", "px")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as prices by buyer group in three currencies; ``ts`` in microseconds."""
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    ccy = F.element_at(F.array(F.lit("USD"), F.lit("GBp"), F.lit("EUR")), (F.col("user_id") % 3 + 1).cast("int"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.concat(F.lit("E"), (F.col("user_id") % 12).cast("string")).alias("symbol"), ccy.alias("currency"), micros.alias("ts"), F.col("value").alias("px"))


def view_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as rates of two currencies; ``ts`` in microseconds."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    ccy = F.when(F.col("user_id") % 2 == 0, "USD").otherwise("GBP")
    return views.select(ccy.alias("ccy"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").alias("rate"))


def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(symbol, universe)``: suppliers by region and in the next region too, so that universes overlap."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    placed = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(nations), "s_nationkey")
    symbol = F.format_string("S%06d", "s_suppkey").alias("symbol")
    own = placed.select(symbol, F.col("n_regionkey").cast("int").alias("universe"))
    also = placed.select(symbol, ((F.col("n_regionkey") + 1) % 5).cast("int").alias("universe"))
    return own.unionByName(also)


def customer_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart payloads of the customers' orders, one row each: plain closes with bad points, and adjusted ones for every other customer."""
    key, price = F.col("o_orderkey") % 7, F.col("o_totalprice").cast("double")
    close = F.when(key == 1, 0.0).when(key == 2, -price).when(key > 2, price)
    points = F.struct(
        _epoch(F.col("o_orderdate")).alias("t"), close.alias("close"), F.when(F.col("o_orderkey") % 5 > 0, price / 2).alias("adjusted")
    )
    found = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(points).alias("p"))
    meta = F.struct(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.when(F.col("o_custkey") % 3 == 0, "USD").otherwise("EUR").alias("currency"),
    )
    adjusted = F.when(F.col("o_custkey") % 2 == 0, F.array(F.struct(F.col("p.adjusted").alias("adjclose"))))
    indicators = F.struct(adjusted.alias("adjclose"), F.array(F.struct(F.col("p.close").alias("close"))).alias("quote"))
    result = F.struct(meta.alias("meta"), F.col("p.t").alias("timestamp"), indicators.alias("indicators"))
    return found.select(F.struct(F.array(result).alias("result")).alias("chart"))


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(updated)``: the date of the last order of each priority, as the header of a table."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("updated")).select("updated")


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and types as raw symbols, one column ``value``."""
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_name").alias("value")).unionByName(parts.select(F.col("p_type").alias("value")))
