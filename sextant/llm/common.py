"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space that separates words in every contract of this package.
BLANKS = " \t\n\x0b\x0c\r"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage.

    The folder is the session's own or the one in ``spark.checkpoint.dir``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where driver and executors are one process (``local[n]``, as in tests) does a
    session without the setting get a temporary folder; a cluster has to name one.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def map_rows(
    df: DataFrame,
    schema: str | StructType,
    per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    text: int | None = None,
) -> DataFrame:
    """Apply ``per_batch`` to every Arrow batch of ``df``; empty batches are skipped.

    With the number of a ``text`` column, batches are first cut to a few MB of it, so
    that no more than that is worked on and held as results at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in [batch] if text is None else short_batches(batch, text):
                if part.num_rows:
                    out = per_batch(part)
                    if out is not None and out.num_rows:
                        yield out

    return df.mapInArrow(run, schema)


def short_batches(batch: pa.RecordBatch, text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``limit`` bytes of column ``text`` (one row at least)."""
    lengths = batch.column(text).cast(pa.large_string()).fill_null("")
    start = size = 0
    offsets = memoryview(lengths.buffers()[1]).cast("q")[lengths.offset : lengths.offset + len(lengths) + 1]
    for i in range(batch.num_rows):
        size += offsets[i + 1] - offsets[i]
        if size >= limit:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def by_place(df: DataFrame, **more: Column) -> DataFrame:
    """``df`` with its columns named ``c0``, ``c1``, ... so that no name added later can meet them, and ``more`` behind."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.select("*", *[c.alias(n) for n, c in more.items()]).toDF(*names, *more)


def with_names(df: DataFrame, names: list[str], **more: Column) -> DataFrame:
    """The columns of a ``by_place`` frame under their own names, then ``more``, which replaces columns of its names."""
    taken = {n.lower() for n in more}
    stay = [i for i, n in enumerate(names) if n.lower() not in taken]
    return df.select(*[f"c{i}" for i in stay], *more.values()).toDF(*[names[i] for i in stay], *more)


def dense_rank_in_key(df: DataFrame, key: str, order: list[str | Column], out: str, buckets: int | None = None) -> DataFrame:
    """Number the rows of each ``key`` from 0 without a gap, in no task a whole key.

    Rows of a key are dealt to ``buckets`` by the hash of the order columns, as many
    as there are shuffle partitions (64 at least) unless told otherwise. A row's
    number is the count of the rows in the key's earlier buckets plus its rank in its
    own. Rows equal in all of ``order`` get their numbers in any order.
    """
    names = [c for c in order if isinstance(c, str)]
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(key).alias("__key"),
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__start"),
    )
    inside = Window.partitionBy(key, "__bucket").orderBy(*order)
    return (
        dealt.withColumn("__rank", F.row_number().over(inside).cast("long"))
        .join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bucket") == F.col("__b")))
        .withColumn(out, F.col("__start") + F.col("__rank") - 1)
        .drop("__bucket", "__key", "__b", "__start", "__rank")
    )


#: Vertices of more neighbours are joined by broadcast, and most of those at a time.
MANY_NEIGHBOURS, MOST_HUBS = 1 << 10, 100_000


def with_least(rows: DataFrame, least: Column, many: int) -> DataFrame:
    """``rows(u, v)`` with ``m``, the ``least`` over the rows of each ``u``.

    A ``u`` of over ``many`` rows is broadcast with its least, the others are joined
    by an exchange, so no task holds the rows of a hub.
    """
    found = rows.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = found.where(F.col("n") > many).select("u", F.col("m").alias("of_hub"))
    marked = rows.join(F.broadcast(hubs), "u", "left")  # at most the number of rows / many
    others = marked.where("of_hub is null").select("u", "v").join(found.where(F.col("n") <= many).select("u", "m"), "u")
    return others.union(marked.where("of_hub is not null").select("u", "v", "of_hub"))


def connected_components(edges: DataFrame, many: int | None = None) -> DataFrame:
    """Component of every vertex in ``edges(a, b)``: ``(vertex, component)``, the smallest vertex.

    Alternates the large-star and small-star steps until the edges no longer
    change. Each step takes the minimum of a vertex' neighbours by a grouped
    aggregate and joins it back; no task holds all neighbours of a vertex that has
    over ``many``: ``MANY_NEIGHBOURS``, and more only where over ``MOST_HUBS`` vertices
    could have so many.
    """

    def symmetric(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))

    def large_star(e: DataFrame, many: int) -> DataFrame:
        out = with_least(symmetric(e), F.least(F.min("v"), F.first("u")), many)
        return out.where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def small_star(e: DataFrame, many: int) -> DataFrame:
        out = with_least(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), F.min("v"), many)
        return out.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = state(edges)
    while now[0]:
        limit = many or max(MANY_NEIGHBOURS, 2 * now[0] // MOST_HUBS)
        edges = checkpointed(small_star(large_star(edges, limit), limit))
        was, now = now, state(edges)
        if was == now:
            break
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(roots)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
