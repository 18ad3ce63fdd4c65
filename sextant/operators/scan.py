"""Running values of series that are too long for one task: blocks of a series, and what the blocks before carry over."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A running value: ``max`` or ``sum`` up to the row, or the value of the row ``before``.
Running = tuple[str, Column]


def _inside(kind: str, value: Column, series) -> Column:
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    return {"max": F.max(value).over(so_far), "sum": F.sum(value).over(so_far), "before": F.lag(value).over(series)}[kind]


def running(rows: DataFrame, keys: Sequence[str], order: str, named: Mapping[str, Running], width: int | None = None) -> DataFrame:
    """``rows`` with the ``named`` running values of each series, in the order of ``order``.

    Without a ``width`` a series is one task's window. With it, each stretch of ``width``
    of the order column is a block of its own: values run inside blocks, one row per
    block runs over the series, and both are put together, which max, sum and the row
    before allow. No task then holds more than a block, and the table that is joined
    back has a row per block.
    """
    if width is None:
        series = Window.partitionBy(*keys).orderBy(order)
        return rows.withColumns({name: _inside(kind, value, series) for name, (kind, value) in named.items()})
    rows = rows.withColumn("__block", F.floor(F.col(order) / width))
    ends = {name: F.max_by(value, F.col(order)) if kind == "before" else getattr(F, kind)(value) for name, (kind, value) in named.items()}
    blocks = rows.groupBy(*keys, "__block").agg(*[end.alias(f"__{name}") for name, end in ends.items()])
    earlier = Window.partitionBy(*keys).orderBy("__block")
    past = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        name: F.lag(f"__{name}").over(earlier) if kind == "before" else getattr(F, kind)(f"__{name}").over(past) for name, (kind, _) in named.items()
    }
    carry = blocks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__at"), *[c.alias(f"__c_{n}") for n, c in carried.items()])
    series = Window.partitionBy(*keys, "__block").orderBy(order)
    first = F.row_number().over(series) == 1
    inside = rows.withColumns({f"__i_{name}": _inside(kind, value, series) for name, (kind, value) in named.items()} | {"__first": first})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__block") == F.col("__at"))
    joined = inside.join(carry, same)

    def whole(name: str, kind: str) -> Column:
        own, before = F.col(f"__i_{name}"), F.col(f"__c_{name}")
        if kind == "before":
            return F.when(F.col("__first"), before).otherwise(own)
        return F.greatest(own, before) if kind == "max" else F.when(own.isNotNull() | before.isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0)))

    return joined.select(*[c for c in rows.columns if c != "__block"], *[whole(name, kind).alias(name) for name, (kind, _) in named.items()])
