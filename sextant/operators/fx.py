"""As-of join of prices with exchange rates, and conversion to one currency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASE = "EUR"
#: Fixed value: quote units that are a hundredth of a currency.
MINOR_UNITS = {"GBp": "GBP"}
BLOCK_SECONDS = 30 * 86_400


def needed_currencies(prices: DataFrame, base: str = BASE) -> DataFrame:
    """Distinct currencies to convert from; hundredths count as their currency, ``base`` and null don't."""
    return prices.select(currency_of().alias("ccy")).where(F.col("ccy").isNotNull() & (F.col("ccy") != "") & (F.col("ccy") != base)).distinct()


def currency_of(column: str = "currency"):
    out = F.col(column)
    for unit, currency in MINOR_UNITS.items():
        out = F.when(F.col(column) == unit, F.lit(currency)).otherwise(out)
    return out


def asof_join(left: DataFrame, right: DataFrame, key: str, value: str, order: str = "ts", block: int = BLOCK_SECONDS, salts: int = 8) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` at or before it, null if there is none.

    Both sides have ``key`` and the integer ``order``. They are laid behind one
    another and the last value is carried forward, in partitions by key, block of
    ``order`` and salt: a key with most of the rows is spread over time and over
    the salts. Each block begins with the last value before it, so only the right
    side, which is repeated once per salt, has to reach all of them. Rows of
    ``left`` that are equal each keep their place.
    """
    at = F.floor(F.col(order) / F.lit(block)).cast("bigint")
    rates = right.select(F.col(key).alias("__k"), F.col(order).alias("__t"), F.col(value).cast("double").alias("__v"), at.alias("__block"))
    points = left.withColumn("__block", at).withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    # The last rate of each block, carried to the blocks of the left side after it.
    lasts = rates.groupBy("__k", "__block").agg(F.max_by("__v", "__t").alias("__v"))
    blocks = points.select(F.col(key).alias("__k"), "__block").distinct().withColumn("__v", F.lit(None).cast("double")).withColumn("__asks", F.lit(1))
    marks = lasts.withColumn("__asks", F.lit(0)).unionByName(blocks.select("__k", "__block", "__v", "__asks"))
    earlier = Window.partitionBy("__k").orderBy("__block").rangeBetween(Window.unboundedPreceding, -1)
    carried = (
        marks.withColumn("__before", F.last("__v", ignorenulls=True).over(earlier))
        .where("__asks = 1 and __before is not null")
        .select("__k", (F.col("__block") * block).alias("__t"), F.col("__before").alias("__v"), "__block", F.lit(-1).alias("__side"))
    )
    sides = rates.withColumn("__side", F.lit(0)).unionByName(carried)
    sides = sides.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    row = F.struct(*left.columns)
    laid = points.select(F.col(key).alias("__k"), "__block", "__salt", F.col(order).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("double").alias("__v"), row.alias("__row"))
    laid = laid.unionByName(sides, allowMissingColumns=True)
    carry = Window.partitionBy("__k", "__block", "__salt").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return laid.withColumn(value, F.last("__v", ignorenulls=True).over(carry)).where("__side = 1").select("__row.*", value)


def to_base(
    prices: DataFrame, fx: DataFrame, base: str = BASE, default_currency: str = "USD", least: int = 3, block: int = BLOCK_SECONDS
) -> DataFrame:
    """``prices(symbol, currency, ts, px)`` in ``base``; ``currency`` stays the original one.

    A null currency is ``default_currency``. Prices in ``base`` pass unchanged.
    Others are divided by the last rate (units per ``base``) at or before them,
    hundredths by 100 as well; points before the first rate or with a rate that
    isn't positive go, and then series of fewer than ``least`` points.
    """
    known = prices.withColumn("currency", F.coalesce("currency", F.lit(default_currency)))
    own = known.where(F.col("currency") == base)
    other = known.where(F.col("currency") != base).withColumn("ccy", currency_of())
    joined = asof_join(other, fx.select("ccy", "ts", "rate"), "ccy", "rate", block=block).where("rate > 0")
    unit = F.when(F.col("currency").isin(list(MINOR_UNITS)), F.lit(100.0)).otherwise(F.lit(1.0))
    converted = joined.withColumn("px", F.col("px") / unit / F.col("rate")).select(*known.columns)
    long = converted.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("symbol")
    return own.unionByName(converted.join(long, "symbol", "left_semi"))
