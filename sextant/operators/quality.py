"""Percentile ranks over a universe and the quality score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import defined
from .ordering import PER_TASK, places

PARTS = ("r2", "min5y", "mar")


def percentile_ranks(rows: DataFrame, columns: tuple[str, ...], tiebreak: str = "symbol", per_task: int = PER_TASK) -> DataFrame:
    """``rows`` with ``rank_<c>`` for each column: its place among the defined values, 0 to 1.

    Equal values don't share a rank; ``tiebreak`` orders them. A single value has
    rank 1 and an undefined one none. No task sorts the universe: it is cut into even
    ranges of value and tiebreak, and the counts of the ranges below are added to a
    row's place in its own.
    """
    keys = {}
    for c in columns:
        value = defined(F.col(c))
        keys[f"__place_{c}"] = F.when(value.isNotNull(), F.struct(value.alias("v"), F.col(tiebreak).alias("t")))
    rows = places(rows, keys, rows.count(), per_task)
    for c in columns:
        place, of = F.col(f"__place_{c}"), F.col(f"__place_{c}_of")
        rank = F.when(of == 1, F.lit(1.0)).otherwise(F.try_divide(place.cast("double"), of - 1))
        rows = rows.withColumn(f"rank_{c}", F.when(place.isNotNull(), rank)).drop(f"__place_{c}", f"__place_{c}_of")
    return rows


def quality_score(rows: DataFrame, undefined_as_zero: bool = False, tiebreak: str = "symbol") -> DataFrame:
    """``rows`` with ``quality``: the mean of the ranks of r2, min5y and mar that are defined.

    ``undefined_as_zero`` ranks an undefined value as 0, as rows read back from an artifact
    are ranked. Counting the rows is an action of its own, which needs none of the
    metrics; beyond ``PER_TASK`` rows the cuts and the sizes of the ranges are two more, so
    keep ``rows`` if they are dear.
    """
    used = tuple(f"__{p}" for p in PARTS)
    for name, part in zip(used, PARTS, strict=True):
        value = defined(F.col(part))
        rows = rows.withColumn(name, F.coalesce(value, F.lit(0.0)) if undefined_as_zero else value)
    ranked = percentile_ranks(rows, used, tiebreak)
    ranks = [F.col(f"rank_{c}") for c in used]
    total = reduce(lambda a, b: a + b, [F.coalesce(r, F.lit(0.0)) for r in ranks])
    count = reduce(lambda a, b: a + b, [r.isNotNull().cast("int") for r in ranks])
    return ranked.withColumn("quality", F.try_divide(total, count)).drop(*used, *[f"rank_{c}" for c in used])
