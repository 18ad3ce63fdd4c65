"""Places in an order without one task that sorts everything: even ranges, and counts of the ranges below."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range on average, and keys drawn for each range to cut it.
PER_TASK, DRAWN = 65_536, 64


def _not_above(cuts: list[Column], key: Column) -> Column:
    return F.size(F.filter(F.array(*cuts), lambda c: c <= key))


def ranges(rows: DataFrame, keys: Sequence[Column], count: int, per_task: int = PER_TASK) -> list[Column]:
    """For each key the number of the range it lies in: ranges of about ``per_task`` of the ``count`` rows.

    Keys are structs that end in something unique, so equal values are cut apart too;
    null keys lie in none. The cuts are taken from keys drawn by their hash: the same
    rows give the same ranges whenever they are computed again.
    """
    wanted = -(-count // per_task)
    if wanted <= 1:
        return [F.when(k.isNotNull(), F.lit(0)) for k in keys]
    one_in = max(1, count // (wanted * DRAWN))
    each = F.array(*[F.struct(F.lit(i).alias("i"), k.alias("key")) for i, k in enumerate(keys)])
    drawn = rows.select(F.explode(each).alias("x")).select("x.i", "x.key").where(F.col("key").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0))
    cuts = drawn.groupBy("i").agg(F.filter(F.array_sort(F.collect_list("key")), lambda _, at: (at + 1) % DRAWN == 0).alias("cuts"))
    kind = drawn.schema["key"].dataType
    found = {r["i"]: r["cuts"] for r in cuts.collect()}  # a key per range
    out = []
    for i, key in enumerate(keys):
        at = [F.struct(*[F.lit(v) for v in cut]).cast(kind) for cut in found.get(i, [])]
        out.append(F.when(key.isNotNull(), _not_above(at, key) if at else F.lit(0)))
    return out


def places(rows: DataFrame, named: dict[str, Column], count: int, per_task: int = PER_TASK) -> DataFrame:
    """``rows`` with, for each name, ``<name>`` (the key's place from 0, null for a null key) and ``<name>_of`` (keys that aren't null)."""
    names, keys = list(named), list(named.values())
    if count <= per_task:  # one range: one sort and no join
        for name, key in named.items():
            whole = Window.partitionBy()
            place = F.row_number().over(whole.orderBy(key.asc_nulls_last())) - 1
            rows = rows.withColumns({name: F.when(key.isNotNull(), place.cast("bigint")), f"{name}_of": F.count(key).over(whole)})
        return rows
    numbers = ranges(rows, keys, count, per_task)
    # Rows without a key are dealt out too, so none of their windows is large.
    spare = -1 - F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(-(-count // per_task)))
    rows = rows.withColumns({f"__r{i}": F.coalesce(n, spare).cast("int") for i, n in enumerate(numbers)})
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__r{i}").alias("r")) for i in range(len(keys))])
    counts = rows.select(F.explode(pairs).alias("x")).where("x.r >= 0").groupBy("x.i", "x.r").agg(F.count(F.lit(1)).alias("n"))
    sizes: list[dict[int, int]] = [{} for _ in keys]
    for row in counts.collect():  # a row per range
        sizes[row["i"]][row["r"]] = row["n"]
    for i, (name, key) in enumerate(zip(names, keys, strict=True)):
        starts = [0]
        for r in range(max(sizes[i], default=0) + 1):
            starts.append(starts[-1] + sizes[i].get(r, 0))
        start = F.get(F.array(*[F.lit(n).cast("bigint") for n in starts]), F.col(f"__r{i}"))
        inside = F.row_number().over(Window.partitionBy(f"__r{i}").orderBy(key)) - 1
        rows = rows.withColumns({name: F.when(key.isNotNull(), inside + start), f"{name}_of": F.lit(starts[-1]).cast("bigint")})
    return rows.drop(*[f"__r{i}" for i in range(len(keys))])


def numbered(rows: DataFrame, order: str, out: str, count: int, per_task: int = PER_TASK) -> DataFrame:
    """The ``count`` rows with ``out``, their place from 0 by the unique column ``order``."""
    return places(rows, {out: F.struct(order)}, count, per_task).drop(f"{out}_of")
