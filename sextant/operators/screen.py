"""The screen: a cascade of thresholds, reject counters, and the best of what is left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import defined
from ..params import ScreenParams

REASONS = ("history", "five_year", "r2", "cagr", "drawdown")


def reject_reason(params: ScreenParams) -> Column:
    """The first threshold a row misses, null if none.

    An undefined metric misses no threshold, unless it counts as 0.
    """

    def misses(name: str, limit: float) -> Column:
        value = defined(F.col(name))
        value = F.coalesce(value, F.lit(0.0)) if params.undefined_as_zero else value
        return F.coalesce(value < F.lit(float(limit)), F.lit(False))

    checks = [
        (F.col("days") < params.least_points(), "history"),
        (misses("min5y", params.tolerance_5y), "five_year"),
        (misses("r2", params.min_r2), "r2"),
    ]
    if params.min_cagr is not None:
        checks.append((misses("cagr", params.min_cagr), "cagr"))
    if params.max_drawdown is not None:
        checks.append((misses("mdd", params.max_drawdown), "drawdown"))
    reason = F.lit(None).cast("string")
    for failed, name in reversed(checks):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    return reason


def with_reason(rows: DataFrame, params: ScreenParams) -> DataFrame:
    return rows.withColumn("reject_reason", reject_reason(params))


def reject_counts(rows: DataFrame, params: ScreenParams) -> DataFrame:
    """``(reason, n)`` for each reason in order of the cascade, 0 included."""
    spark = rows.sparkSession
    names = spark.createDataFrame(list(enumerate(REASONS)), "ord int, reason string")
    counts = with_reason(rows, params).where("reject_reason is not null").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
    joined = names.join(counts, F.col("reason") == F.col("reject_reason"), "left")
    return joined.select("ord", "reason", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def survivors(rows: DataFrame, params: ScreenParams) -> DataFrame:
    return rows.where(reject_reason(params).isNull())


def top(rows: DataFrame, params: ScreenParams, tiebreak: str = "symbol", ascending: bool = False) -> DataFrame:
    """The first ``top_n`` rows by ``sort_by``, undefined last; ``ascending`` shows the same rows reversed."""
    key = defined(F.col(params.sort_by)) if dict(rows.dtypes)[params.sort_by] == "double" else F.col(params.sort_by)
    best = rows.orderBy(key.desc_nulls_last(), F.col(tiebreak).asc())
    best = best.limit(params.top_n) if params.top_n else best
    return best.orderBy(key.asc_nulls_first(), F.col(tiebreak).desc()) if ascending else best


def screen(rows: DataFrame, params: ScreenParams, tiebreak: str = "symbol") -> DataFrame:
    """The picks: rows that miss no threshold, best first."""
    return top(survivors(rows, params), params, tiebreak)


def settled(picks: DataFrame, params: ScreenParams) -> DataFrame:
    """Picks or their weights as a table of their own, so that what follows doesn't screen again.

    A screen with ``top_n`` has that many picks at most; one without stays lazy.
    """
    return picks.sparkSession.createDataFrame(picks.collect(), picks.schema) if params.top_n else picks


def bounded(picks: DataFrame, params: ScreenParams) -> DataFrame:
    """The picks with a hint to broadcast them where ``top_n`` bounds their number."""
    return F.broadcast(picks) if params.top_n else picks


def screen_summary(rows: DataFrame, params: ScreenParams) -> DataFrame:
    """One row: analysed, passed, shown, and a counter per reject reason."""
    tagged = with_reason(rows, params)
    passed = F.count_if(F.col("reject_reason").isNull())
    shown = F.least(passed, F.lit(params.top_n).cast("bigint")) if params.top_n else passed
    return tagged.agg(
        F.count(F.lit(1)).alias("analysed"),
        passed.alias("passed"),
        shown.alias("shown"),
        *[F.count_if(F.col("reject_reason") == r).alias(f"rejected_{r}") for r in REASONS],
    )


@dataclass(frozen=True)
class ScreenResult:
    """What a screen gives, all lazy."""

    picks: DataFrame
    rejects: DataFrame
    passed: DataFrame

    @staticmethod
    def of(rows: DataFrame, params: ScreenParams) -> ScreenResult:
        passed = survivors(rows, params).agg(F.count(F.lit(1)).alias("passed"))
        return ScreenResult(screen(rows, params), reject_counts(rows, params), passed)
