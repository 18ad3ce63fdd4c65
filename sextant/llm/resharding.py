"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities.

The layout is known by block: an old shard is cut into a fixed number of blocks
by the hash of the text, so equal texts share a block, and a block too heavy to
move as one is cut further by more of the same hash, so that equal texts share a
piece too. Block sizes are summed by Spark. Their number has a fixed bound whatever the input, and the flow and the
choice of blocks are solved on it. Rows then look up where their block goes.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, checkpointed, dense_rank_in_key, with_names

SHARDS = 16
BLOCKS = 256
#: A block of more than 1/HEAVY of all bytes is cut to pieces of about 1/FINE of them.
HEAVY, FINE = 2048, 16384


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Bytes to send from each old to each new shard; all supply is sent.

    Successive shortest paths with potentials on the bipartite graph of shards.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards hold less than there is")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    potential = [0] * (n + m)
    while any(left):
        far: list[float] = [float("inf")] * (n + m)
        came = [-1] * (n + m)
        queue = []
        for i in range(n):
            if left[i]:
                far[i] = 0
                queue.append((0, i))
        heapq.heapify(queue)
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            if u < n:
                arcs = [(n + j, cost[u][j]) for j in range(m)]
            else:
                arcs = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in arcs:
                to = d + c + potential[u] - potential[v]
                if to < far[v]:
                    far[v], came[v] = to, u
                    heapq.heappush(queue, (to, v))
        end = min((j for j in range(m) if room[j]), key=lambda j: far[n + j] + potential[n + j])
        path, u = [], n + end
        while came[u] >= 0:
            path.append((came[u], u))
            u = came[u]
        amount = min([left[u], room[end], *[flow[b][a - n] for a, b in path if a >= n]])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[u] -= amount
        room[end] -= amount
        best = far[n + end]
        potential = [p + min(d, best) for p, d in zip(potential, far, strict=True)]
    return flow


def near_equal(total: int, shards: int) -> list[int]:
    """Capacities that add up to ``total`` and differ by one at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def block_moves(blocks: list[tuple[int, int, int, int]], flow: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """``(old, block, piece, new)`` for each moved block of ``(old, block, piece, size)``.

    For each arc of the flow, the largest blocks that still fit go first; a last
    block goes if that leaves the arc nearer to its bytes.
    """
    moved = []
    by_shard = defaultdict(list)
    for old, block, piece, size in blocks:
        by_shard[old].append((size, block, piece))
    for old, arcs in enumerate(flow):
        here = sorted(by_shard[old], reverse=True)
        for new, want in sorted(enumerate(arcs), key=lambda x: -x[1]):
            if new == old or not want:
                continue
            stay = []
            for size, block, piece in here:
                if size <= want:
                    moved.append((old, block, piece, new))
                    want -= size
                else:
                    stay.append((size, block, piece))
            if stay and want > abs(stay[-1][0] - want):
                size, block, piece = stay.pop()
                moved.append((old, block, piece, new))
            here = stay
        if old >= len(arcs):  # a shard that goes leaves nothing behind
            most = max(range(len(arcs)), key=lambda j: arcs[j])
            moved += [(old, block, piece, most) for _, block, piece in here]
    return moved


def _placed(docs: DataFrame, shards: int, old_shard: Column | None, cost: list[list[int]] | None, length: Column | None = None) -> DataFrame:
    """``docs`` by place with ``text``, ``bytes``, ``old`` and ``new``.

    With ``length``, ``text`` may be a digest of the text, whose bytes it tells.
    """
    spark, text = docs.sparkSession, F.col("text").cast("string")
    old = F.pmod(F.xxhash64(text), F.lit(shards)).cast("int") if old_shard is None else old_shard.cast("int")
    size = F.octet_length(F.coalesce(text, F.lit(""))) if length is None else length
    sized = by_place(docs, text=text, old=old, bytes=size.cast("long") + 1)
    mixed = F.xxhash64(F.lit("block"), "text")
    sized = sized.withColumn("block", F.pmod(mixed, F.lit(BLOCKS)).cast("int")).withColumn("rest", F.shiftright(mixed, 8))
    summed = sized.groupBy("old", "block").agg(F.sum("bytes").alias("size")).collect()
    total = sum(r["size"] for r in summed)
    heavy = [(r["old"], r["block"], -(-r["size"] * FINE // total)) for r in summed if r["size"] * HEAVY > total]
    cuts = F.broadcast(spark.createDataFrame(heavy, "h_old int, h_block int, pieces int"))
    is_cut = (F.col("old") == F.col("h_old")) & (F.col("block") == F.col("h_block"))
    sized = sized.join(cuts, is_cut, "left").withColumn("piece", F.coalesce(F.pmod("rest", "pieces"), F.lit(0)).cast("int"))
    blocks = [(r["old"], r["block"], 0, r["size"]) for r in summed if r["size"] * HEAVY <= total]
    if heavy:
        fine = sized.where("h_old is not null").groupBy("old", "block", "piece").agg(F.sum("bytes").alias("size"))
        blocks += [tuple(r) for r in fine.collect()]
    size_of = defaultdict(int)
    for o, _, _, size in blocks:
        size_of[o] += size
    span = max([shards - 1, *size_of]) + 1
    price = cost or [[int(i != j) for j in range(shards)] for i in range(span)]
    moves = block_moves(blocks, min_cost_flow([size_of[o] for o in range(span)], near_equal(total, shards), price))
    plan = F.broadcast(spark.createDataFrame(moves, "m_old int, m_block int, m_piece int, m_new int"))
    same = (F.col("old") == F.col("m_old")) & (F.col("block") == F.col("m_block")) & (F.col("piece") == F.col("m_piece"))
    return sized.join(plan, same, "left").withColumn("new", F.coalesce("m_new", "old"))


def reshard(docs: DataFrame, shards: int = SHARDS, old_shard: Column | None = None, cost: list[list[int]] | None = None) -> DataFrame:
    """``docs`` plus ``__size``, ``__old``, ``__new``, which replace columns of these names: where each row is and where it goes.

    ``old_shard`` is an integer column of the layout to change, not negative; without one
    the text's hash decides, as a first layout. ``cost`` is what a byte costs from an
    old to a new shard; without one every move costs 1 and staying nothing. A null
    text has no bytes; every row counts one byte more. No rows give no rows.
    Rows of equal text that are in one old shard share a new one; so texts that make
    up more than a shard's share of all bytes make that shard larger than the others.
    """
    out = _placed(docs, shards, old_shard, cost)
    return with_names(out, docs.columns, __size=F.col("bytes"), __old=F.col("old"), __new=F.col("new"))


def rewrite_affected(docs: DataFrame, folder: str, shards: int = SHARDS, shard_column: str = "shard") -> tuple[list[int], DataFrame]:
    """Reshard a table that has its shard in ``shard_column`` and write only the shards that change.

    The changed shards go to ``folder``, one directory each; the rest stay where
    they are. Returns the changed shards and the whole table in its new layout.
    """
    moved = _placed(docs, shards, F.col(shard_column), None)
    changes = moved.where("old <> new").select(F.explode(F.array("old", "new")).alias("s")).distinct()
    changed = sorted(r["s"] for r in changes.collect())
    if not changed:
        return [], docs
    rows = moved.select(*[F.col("new") if n == shard_column else F.col(f"c{i}") for i, n in enumerate(docs.columns)]).toDF(*docs.columns)
    rows.where(F.col(shard_column).isin(changed)).write.mode("overwrite").partitionBy(shard_column).parquet(folder)
    rest = docs.where(~F.col(shard_column).cast("int").isin(changed)).withColumn(shard_column, F.col(shard_column).cast("int"))
    written = docs.sparkSession.read.parquet(folder).select(*docs.columns)
    return changed, rest.unionByName(written)


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row; the law is ``bytes``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select("doc_id", F.octet_length(text).alias("n"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(text, 256).alias("text"))
    small = _placed(checkpointed(read), shards, None, None, F.col("n"))
    small = small.select(F.col("c0").alias("doc_id"), F.col("bytes").alias("size"), F.col("c2").alias("text_crc32"), F.col("new").alias("shard"))
    slotted = dense_rank_in_key(small, "shard", ["doc_id", "size", "text_crc32"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
