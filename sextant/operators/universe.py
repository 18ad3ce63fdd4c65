"""Universes: cleaning of symbol lists, unions, pools, and the choice of a benchmark."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DAILY
from .quality import quality_score

# Order of universes, their benchmarks, header words of symbol lists.
ORDER = ("SP500", "NYSE", "NASDAQ", "STOXX600")
US = ("SP500", "NYSE", "NASDAQ")
OWN_INDEX = {"SP500": "^GSPC", "NYSE": "^NYA", "NASDAQ": "^IXIC", "STOXX600": "^STOXX"}
MIXED_INDEX, US_INDEX = "ACWI", "^GSPC"
HEADER_WORDS = ("NAN", "SYMBOL", "TICKER")
PRESETS = {"us": US, "eu": ("STOXX600",), "all": ORDER}


def _hyphenated(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit("."), F.lit("-"))


def clean_tickers(lines: DataFrame, column: str = "value", longest: int = 6) -> DataFrame:
    """``(symbol)``: lines trimmed, upper-cased, dots to hyphens; empty, long and header lines go; distinct."""
    symbol = F.upper(_hyphenated(F.col(column)))
    out = lines.select(symbol.alias("symbol"))
    return out.where((F.length("symbol") > 0) & (F.length("symbol") <= longest) & ~F.col("symbol").isin(*HEADER_WORDS)).distinct()


def constituent_symbols(rows: DataFrame, column: str = "Symbol") -> DataFrame:
    """``(symbol)`` of a constituents table, trimmed and hyphenated only."""
    return rows.select(_hyphenated(F.col(column)).alias("symbol")).where(F.length("symbol") > 0)


def select_universes(wanted: Sequence[str], known: Sequence[str] = ORDER) -> tuple[str, ...]:
    """The wanted universes in their fixed order; at least one, and only known ones."""
    unknown = [u for u in wanted if u not in known]
    if unknown or not wanted:
        raise ValueError(f"unknown universe {unknown[0]}" if unknown else "choose a universe")
    return tuple(u for u in known if u in set(wanted))


def toggled(selected: Sequence[str], universe: str) -> tuple[str, ...]:
    """The selection with ``universe`` switched; the last one stays."""
    now = set(selected) ^ {universe}
    return select_universes(tuple(now or selected))


def union_first_wins(tables: Sequence[DataFrame], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """All rows of the tables; of rows with equal keys only the first table's first stays.

    The winner is a minimum per key, which combines before the shuffle.
    """
    tagged = [t.withColumn("universe_ord", F.lit(i)) for i, t in enumerate(tables)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    others = [c for c in both.columns if c not in keys]
    one = both.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct("universe_ord", *_orderable(both, others))).alias("row"))
    return one.select(*keys, "row.*")


def _orderable(df: DataFrame, columns: Sequence[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [c for c in columns if c != "universe_ord" and not kinds[c].startswith("map")]


def union_curves(tables: Sequence[DataFrame]) -> DataFrame:
    """Monthly curves of several universes; a symbol's curve comes from the first that has it."""
    tagged = [t.withColumn("universe_ord", F.lit(i)) for i, t in enumerate(tables)]
    return first_curves(reduce(lambda a, b: a.unionByName(b), tagged)).drop("universe_ord")


def first_curves(curves: DataFrame) -> DataFrame:
    """The rows of ``curves(symbol, universe_ord, ...)`` whose universe is the first that has the symbol.

    The rows are read once, and a task holds one series at a time. Universes that come
    of one table are better tagged there than put together by ``union_curves``: Spark
    runs equally dealt branches of a union in the same tasks, each with its own sorts.
    """
    first = F.min("universe_ord").over(Window.partitionBy("symbol"))
    return curves.where("symbol is not null").withColumn("__first", first).where(F.col("universe_ord") == F.col("__first")).drop("__first")


def union_and_rank(tables: Sequence[DataFrame], undefined_as_zero: bool = True) -> DataFrame:
    """Metric rows of several universes, ranked anew over all of them."""
    merged = union_first_wins([t.drop("quality") for t in tables])
    return quality_score(merged, undefined_as_zero).drop("universe_ord")


def latest_update(headers: DataFrame) -> DataFrame:
    """The latest ``updated`` of the artifacts' headers."""
    return headers.agg(F.max("updated").alias("updated"))


def benchmark_of(universes: Sequence[str]) -> str:
    """The index to compare a choice of universes with."""
    chosen = select_universes(universes)
    europe, us = "STOXX600" in chosen, [u for u in chosen if u in US]
    if europe and us:
        return MIXED_INDEX
    if europe:
        return OWN_INDEX["STOXX600"]
    return OWN_INDEX[us[0]] if len(us) == 1 else US_INDEX


def choose_benchmark(benchmarks: DataFrame, universes: Sequence[str], fallback: DataFrame | None = None) -> DataFrame:
    """The monthly curve of the chosen index, or ``fallback`` if the table lacks it."""
    wanted = benchmarks.where(F.col("symbol") == benchmark_of(universes)).select("month_idx", "px")
    if fallback is None:
        return wanted
    none = wanted.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return wanted.unionByName(fallback.select("month_idx", "px").join(F.broadcast(none), F.lit(True), "left_semi"))


def eligible_pool(rows: DataFrame, min_years: int = 8, min_r2: float = 0.70, ppy: int = DAILY) -> DataFrame:
    """Rows whose curves are worth keeping for any position of the thresholds."""
    return rows.where(_eligible(min_years, min_r2, ppy))


def pool_sizes(rows: DataFrame, keys: Sequence[str] = (), min_years: int = 8, min_r2: float = 0.70, ppy: int = DAILY) -> DataFrame:
    """``(*keys, count, eligible)``: series, and those of the eligible pool; one row of zeros for no rows and no keys."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.count_if(_eligible(min_years, min_r2, ppy)).alias("eligible"))


def _eligible(min_years: int, min_r2: float, ppy: int) -> Column:
    return (F.col("days") >= min_years * ppy) & (F.col("r2") >= min_r2)


def missing_count(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """How many of the wanted symbols aren't available."""
    return wanted.select("symbol").distinct().join(available.select("symbol").distinct(), "symbol", "left_anti").agg(F.count(F.lit(1)).alias("dropped"))
