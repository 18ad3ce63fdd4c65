"""SimHash near-duplicate groups by tiled exact comparison of fingerprints.

Fingerprints are cut into cells that hold every pair to be found, and a cell's into
tiles of equal population count. Tile pairs whose counts differ beyond the radius are
skipped, all pairs of the others are compared by exclusive-or and bit count in numpy.

Fingerprints within ``radius`` bits agree in at least ``p - radius`` of ``p`` parts, so
for groups by fingerprint a cell is a choice of ``p - radius`` parts and their bits. The
number of parts follows that of the fingerprints: at a radius of 4, five parts (five
copies of a fingerprint, 12 bits a cell) serve up to some 10^8, six (15 copies, 20 bits)
some 10^10 and seven (35 copies, 27 bits) some 10^12, so a cell's size doesn't grow with
the corpus. Near copies by shingle sets lie too many bits apart for that. There a cell
holds the sets with the same least shingle in one of ``KEYS`` orders: sets of similarity
s have the same least shingle of an order with probability s, so a pair at 0.8 is in no
common cell once in 15,000. A set is sent ``KEYS`` times and meets only sets that share a
shingle with it. Found fingerprints are compared by their whole sets. Sets of few
shingles, whose fingerprints are coarse, are linked exactly by the hashes of their
subsets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MANY_NEIGHBOURS, MOST_HUBS, checkpointed, connected_components, map_rows, short_batches, with_least

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints that a cell is made for, those up to which it may grow before there are more parts, and most of one piece of it.
CELL, FULL_CELL, CHUNK = 1 << 12, 1 << 15, 1 << 20
#: Near copies: words of a shingle, similarity of the sets, bits of 128 and of the first 64 within which pairs are sought.
SET_WORDS, SIMILARITY = 5, 0.8
SET_RADIUS, SET_FIRST = 30, 20
#: Orders of the shingles whose least ones are a set's cells, and sets of a cell that are never cut to pieces.
KEYS, SMALL_CELL = 6, 1 << 8
#: Most shingles of a set that is linked to its subsets of one shingle less by their hashes.
FEW_SHINGLES = 8
#: Shingles of a proposed group that are compared in one piece.
MOST_HASHES = 1 << 21

_ONES = np.uint64(0x0101010101010101)
_ORDERS = np.array([xxhash.xxh64_intdigest(bytes([k]), SEED) | 1 for k in range(KEYS)], np.uint64)


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = end - size
    spans = zip(start[: 1 - words].tolist(), end[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[i:j], seed) for i, j in spans), np.uint64, len(parts) - words + 1)


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of hashes: a bit is 1 if set in over half of them.

    Eight byte-wide counters share a word, so a run adds up at most 255 hashes.
    """
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(counts)
    if not full.size:
        return out
    flat = np.concatenate([hashes[i] for i in full])
    first = np.cumsum(counts[full]) - counts[full]
    runs = -(-counts[full] // 255)
    of_run = np.cumsum(runs) - runs
    run_start = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(of_run, runs))
    for bit in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(bit)) & _ONES, run_start)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of_run, axis=0)
        major = (2 * ones > counts[full, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(major).view(np.uint64)[:, 0] << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` of every row of ``docs(doc_id, text)``; null and blank texts have 0."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = [
            majority_bits([shingle_hashes(t, words) for t in part.column(1).to_pylist()])
            for part in short_batches(batch, 1)
        ]
        fp = np.concatenate(bits).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, fp long", per_batch)


@dataclass
class _Tiles:
    """Fingerprints in order of population count, and which of them are known to be linked."""

    fp: np.ndarray  # fingerprints x words of 64 bits
    rep: np.ndarray
    radius: int
    #: Most differing bits in the first word; a first sieve where there are several.
    first: int

    def __post_init__(self):
        ones = np.bitwise_count(self.fp).sum(axis=1, dtype=np.int64)
        order = np.argsort(ones, kind="stable")
        self.fp, self.rep = np.ascontiguousarray(self.fp[order].T), self.rep[order]
        self.starts = np.searchsorted(ones[order], np.arange(64 * len(self.fp) + 2))
        self.parent = np.arange(len(self.rep))

    def _roots(self, at: np.ndarray) -> np.ndarray:
        roots = self.parent[at]
        while (self.parent[roots] != roots).any():
            roots = self.parent[roots]
        self.parent[at] = roots
        return roots

    def links(self, fp: np.ndarray, rep: np.ndarray) -> Iterator[tuple[int, int]]:
        """Edges that connect each visitor with all it lies near to; a spanning set, not all pairs."""
        if not len(rep) or not len(self.rep):
            return
        ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
        order = np.argsort(ones, kind="stable")
        fp, rep, ones = fp[order], rep[order], ones[order]
        new = np.flatnonzero(np.r_[True, ones[1:] != ones[:-1]])
        for i, j in zip(new, [*new[1:], len(ones)], strict=True):
            low, high = max(0, ones[i] - self.radius), min(len(self.starts) - 2, ones[i] + self.radius)
            low, high = int(self.starts[low]), int(self.starts[high + 1])
            if low < high:
                yield from self._against(fp[i:j], rep[i:j], low, high)

    def _against(self, fp: np.ndarray, rep: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
        step, size = max(1, (1 << 18) // (high - low)), len(self.rep)
        for i in range(0, len(fp), step):
            part = fp[i : i + step]
            far = np.bitwise_count(part[:, 0, None] ^ self.fp[0, None, low:high])
            v, h = np.nonzero(far <= self.first)
            if not v.size:
                continue
            far = far[v, h].astype(np.int64)
            for word in range(1, len(self.fp)):
                far += np.bitwise_count(part[v, word] ^ self.fp[word, low + h])
            v, h = v[far <= self.radius], low + h[far <= self.radius]
            pairs = np.unique(v * size + self._roots(h))
            one, root = np.divmod(pairs, size)
            yield from zip(rep[i + one].tolist(), self.rep[root].tolist(), strict=True)
            for k in np.flatnonzero(one[1:] == one[:-1]):  # a visitor between two known groups joins them
                a, b = self._roots(root[k : k + 2])
                self.parent[max(a, b)] = min(a, b)


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The two sides of each cell piece by piece; rows come sorted by ``cell``, ``one``, ``two`` and ``side``.

    Rows that are alone meet nothing and are passed over.
    """
    held: list[pa.RecordBatch] = []
    at = None

    def sides() -> tuple[pa.Table, pa.Table]:
        rows = pa.Table.from_batches(held)
        side = rows["side"].to_numpy()
        cut = int(np.searchsorted(side, 1))
        home = rows.slice(0, cut)
        return home, home if at[1] == at[2] else rows.slice(cut)

    for batch in batches:
        cell, one, two = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(cell):
            continue
        turn = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]), True])
        starts, ends = turn[:-1], turn[1:]
        met = (ends - starts > 1) | (starts == 0) | (ends == len(cell))
        for i, j in zip(starts[met], ends[met], strict=True):
            key = (cell[i], one[i], two[i])
            if held and key != at:
                yield sides()
                held = []
            at = key
            held.append(batch.slice(i, j - i))
    if held:
        yield sides()


def _words(rows: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([rows[n].to_numpy().view(np.uint64) for n in names], axis=1)


def _edges(found: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(list(found), np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])


def _compare(radius: int, names: list[str], first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for home, visitors in _by_cell(batches):
            tiles = _Tiles(_words(home, names), home["rep"].to_numpy(), radius, first)
            yield _edges(tiles.links(_words(visitors, names), visitors["rep"].to_numpy()))

    return run


def _within(cell: Column, home: Column, pieces: Column) -> Column:
    """Where a row of a cell's piece ``home`` goes so that it meets all rows of the cell: each pair of pieces is a task."""

    def place(other: Column) -> Column:
        return F.struct(
            cell.cast("long").alias("cell"),
            F.least(home, other).alias("one"),
            F.greatest(home, other).alias("two"),
            (home > other).cast("int").alias("side"),
        )

    return F.transform(F.sequence(F.lit(0), pieces - 1), place)


def _met(rows: DataFrame) -> DataFrame:
    """``rows(band, pieces, rep, fp, ...)`` at all places of their band, dealt and sorted for ``_by_cell``."""
    rows = rows.withColumn("home", F.pmod(F.xxhash64("fp", "rep"), F.col("pieces")).cast("int"))
    kept = [c for c in rows.columns if c not in ("band", "pieces", "home")]
    at = rows.select(F.explode(_within(F.col("band"), F.col("home"), F.col("pieces"))).alias("at"), *kept)
    at = at.select("at.cell", "at.one", "at.two", "at.side", *kept)
    return at.repartition("cell", "one", "two").sortWithinPartitions("cell", "one", "two", "side")


def _cut(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows(band, ...)`` with the ``pieces`` of their band: one, or more of at most about ``chunk`` rows.

    Only bands of over ``chunk`` rows are broadcast, at most one for each ``chunk`` rows.
    """
    sizes = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("pieces")).where("pieces > 1")
    return rows.join(F.broadcast(sizes), "band", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))


def _spread(df: DataFrame) -> DataFrame:
    """``df`` over all shuffle partitions, so that few tasks with many copies to make don't hold the rest up."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def layout(count: int, radius: int = RADIUS) -> tuple[int, int]:
    """``(parts, slots)`` for ``count`` fingerprints: the fewest parts whose cells hold at most ``FULL_CELL`` of them on average.

    A cell is one of ``slots`` values of the bits of ``parts - radius`` parts.
    """
    parts = radius + 1
    while count > FULL_CELL << _least_bits(parts, radius) and comb(parts + 1, radius) <= 128:
        parts += 1
    return parts, 1 << min(_least_bits(parts, radius), max(0, count // CELL).bit_length())


def _least_bits(parts: int, radius: int) -> int:
    """Bits of the ``parts - radius`` shortest of ``parts`` parts of 64 bits."""
    return sum(sorted((k + 1) * 64 // parts - k * 64 // parts for k in range(parts))[: parts - radius])


def in_cells(reps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """``reps(fp, rep)`` in the cells of their parts, and more often only in cells of over ``chunk``.

    Cells are as many as give them ``CELL`` fingerprints or the parts have bits for.
    ``parts`` are as ``layout`` finds them unless given.
    """
    fitting, slots = layout(reps.count(), radius)
    parts = parts or fitting
    cuts = [k * 64 // parts for k in range(parts + 1)]
    chosen = list(combinations(range(parts), parts - radius))

    def bits(choice: tuple[int, ...]) -> Column:
        """The bits of some parts side by side."""
        pieces = [(F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)), cuts[k + 1] - cuts[k]) for k in choice]
        return reduce(lambda done, piece: (F.shiftleft(done[0], piece[1]).bitwiseOR(piece[0]), done[1] + piece[1]), pieces)[0]

    cells = F.array(*[F.pmod(bits(c), F.lit(slots)) * len(chosen) + i for i, c in enumerate(chosen)])
    rows = _spread(reps.select("fp", "rep")).select(F.explode(cells).alias("band"), "fp", "rep")
    return _met(_cut(rows, chunk))


def near_links(reps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` between the ``rep`` of distinct ``reps(fp, rep)`` that connect all pairs within ``radius`` bits."""
    return in_cells(reps, radius, chunk, parts).mapInArrow(_compare(radius, ["fp"], radius), "a long, b long")


def simhash_components(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs(doc_id, text, ...)``.

    Words are split at ASCII white space after lower-casing A-Z; null, empty and
    blank texts have fingerprint zero and are linked like any other. Fingerprints
    link at ``radius`` or fewer differing bits; ``component_id`` is the smallest
    ``doc_id`` reachable. Rows without a ``doc_id`` get the component of their
    fingerprint's group, null if no row of it has one. Repeated rows are returned
    as often as they come, other columns are ignored, no rows give none.
    """
    fps = checkpointed(fingerprints(docs, words))
    reps = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    links = connected_components(near_links(reps, radius))
    groups = reps.join(links, F.col("rep") == F.col("vertex"), "left").select(
        F.col("fp").alias("group_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(groups, F.col("fp") == F.col("group_fp"), "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def shingle_set(text: str | None, words: int = SET_WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def content_of(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other bits of the same shingles, for a fingerprint's second word."""
    out = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def least_shingles(hashes: np.ndarray) -> np.ndarray:
    """The least of a set in each order, a product modulo 2**64; none of an empty set."""
    return np.array([(hashes * k).min() for k in _ORDERS] if len(hashes) else [], np.uint64)


def shorter_contents(hashes: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """``content_of`` each subset of one shingle less, for sets of ``FEW_SHINGLES`` at most where it is similar enough.

    At similarity 0.8 sets of which the smaller has under 8 shingles are similar if and
    only if they are equal or the smaller is such a subset of the other.
    """
    n = len(hashes)
    if not 1 < n <= FEW_SHINGLES or (n - 1) / n < similarity - 1e-12:
        return []
    return [content_of(np.delete(hashes, k)) for k in range(n)]


def set_fingerprints(docs: DataFrame, words: int = SET_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, content, n, fp, fp2, least, shorter)``: hash and size of each row's shingle set, its 128-bit fingerprint, its least shingles and the hashes of its subsets."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
        bits = [majority_bits(sets), majority_bits([_mixed(s) for s in sets])]
        made = [pa.array([content_of(s) for s in sets], pa.int64()), pa.array(map(len, sets), pa.int64()), *[pa.array(b.view(np.int64)) for b in bits]]
        least = pa.array([least_shingles(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
        shorter = pa.array([shorter_contents(s, similarity) for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), *made, least, shorter], names=["doc_id", "content", "n", "fp", "fp2", "least", "shorter"])

    return map_rows(docs, "doc_id long, content long, n long, fp long, fp2 long, least array<long>, shorter array<long>", per_batch, text=1)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``(own_content, hashes)`` of every row of ``docs(doc_id, text)``."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
        made = [pa.array([content_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(made, names=["own_content", "hashes"])

    return map_rows(docs, "own_content long, hashes array<long>", per_batch, text=1)


def sets_in_cells(reps: DataFrame, chunk: int | None = None) -> DataFrame:
    """``reps(rep, fp, fp2, least)`` in the cells of their least shingles, ``KEYS`` times each and more only in large cells.

    A cell of over ``chunk`` sets, a 64th of all unless told otherwise, is cut to
    pieces, each pair of which is a task: a passage that many sets have, or a large
    group of near copies, is spread too.
    """
    chunk = chunk or min(CHUNK, max(SMALL_CELL, reps.count() // 64))
    rows = _spread(reps.select("rep", "fp", "fp2", "least")).select(F.posexplode("least").alias("key", "shingle"), "rep", "fp", "fp2")
    return _met(_cut(rows.select(F.xxhash64("key", "shingle").alias("band"), "rep", "fp", "fp2"), chunk))


def set_candidates(reps: DataFrame, radius: int = SET_RADIUS, chunk: int | None = None) -> DataFrame:
    """Edges that connect all ``reps(rep, fp, fp2, least)`` of a common cell within ``radius`` bits."""
    return sets_in_cells(reps, chunk).mapInArrow(_compare(radius, ["fp", "fp2"], SET_FIRST), "a long, b long")


def subset_links(reps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` from each of ``reps(content, rep, shorter)`` to the sets that ``shorter`` names.

    A set that many others hold is a hub, which is broadcast.
    """
    named = reps.where(F.size("shorter") > 0).select(F.explode("shorter").alias("u"), F.col("rep").alias("v"), F.lit(False).alias("own"))
    rows = named.union(reps.where(F.col("n") < FEW_SHINGLES).select("content", "rep", F.lit(True)))
    many = max(MANY_NEIGHBOURS, rows.count() // MOST_HUBS)
    linked = with_least(rows, F.min(F.when(F.col("own"), F.col("v"))), many)
    return linked.where("m is not null and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _similar(similarity: float, radius: int):
    """Edges between the members of a group whose whole sets are similar enough; a spanning set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for home, visitors in _by_cell(batches):
            found, parent = [], list(range(home.num_rows))
            sets, fps, reps = _hash_sets(home), _words(home, ["fp", "fp2"]), home["rep"].to_pylist()
            sizes = np.array([len(s) for s in sets])
            same = visitors is home

            def root(k: int) -> int:
                while parent[k] != k:
                    parent[k] = k = parent[parent[k]]
                return k

            their = sets if same else _hash_sets(visitors)
            their_fps, their_reps = (fps, reps) if same else (_words(visitors, ["fp", "fp2"]), visitors["rep"].to_pylist())
            for v, (one, fp, rep) in enumerate(zip(their, their_fps, their_reps, strict=True)):
                last = v if same else len(sets)
                far = np.bitwise_count(fps[:last] ^ fp).sum(axis=1)
                size = sizes[:last]
                near = np.flatnonzero((far <= radius) & (np.minimum(size, len(one)) >= similarity * np.maximum(size, len(one)) - 1e-9))
                mine = {root(v)} if same else set()
                for h in near[np.argsort(far[near], kind="stable")].tolist():
                    if root(h) not in mine and _jaccard(sets[h], one) >= similarity - 1e-12:
                        found.append((rep, reps[h]))
                        for other in (*mine, *((v,) if same else ())):
                            a, b = sorted((root(h), root(other)))
                            parent[b] = a
                        mine = {root(h)}
            yield _edges(found)

    return run


def _hash_sets(rows: pa.Table) -> list[np.ndarray]:
    return [h.values.to_numpy().view(np.uint64) for h in rows["hashes"]]


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets in ascending order."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return common / (len(a) + len(b) - common)


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, words: int = SET_WORDS, most_hashes: int = MOST_HASHES) -> DataFrame:
    """``(doc_id, component_id)`` of the rows of ``docs(doc_id, text, ...)`` with an id.

    Words are those of the fingerprints; a text of ``words`` words or fewer is one
    shingle and blank texts are equal. Sets of ``similarity`` or more link, and
    ``component_id`` is the smallest ``doc_id`` reachable. Fingerprints of 128 bits
    propose groups: a pair at similarity 0.8 lies within ``SET_RADIUS`` bits with
    probability 0.99 (0.986 for 12 shingles of 15) and in a common cell with 0.9999, nearer ones almost surely. Sets of
    few shingles have coarser fingerprints, so where the smaller has under
    ``FEW_SHINGLES`` all pairs at 0.8 or more are found by the hashes of subsets. In a
    proposed group whole sets decide; members already known to be linked aren't
    compared again, and groups of more than ``most_hashes`` shingles, or a 64th of all
    groups' shingles, are cut to pieces, each pair of which is a task.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    signed = checkpointed(set_fingerprints(docs, words, similarity))
    first = F.first(F.struct("n", "fp", "fp2", "least", "shorter")).alias("x")
    reps = checkpointed(signed.groupBy("content").agg(F.min("doc_id").alias("rep"), first).select("content", "rep", "x.*"))
    proposed = connected_components(set_candidates(reps)).select(F.col("vertex").alias("rep"), F.col("component").alias("group"))
    members = checkpointed(reps.drop("least", "shorter").join(proposed, "rep"))
    texts = docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = _sets(texts, words).dropDuplicates(["own_content"])
    total = members.agg(F.sum("n")).first()[0] or 0
    most = max(1, min(most_hashes, total // 64))
    large = members.groupBy("group").agg(F.ceil(F.sum("n") / most).cast("int").alias("pieces"))
    rows = members.join(large, "group").join(sets, F.col("content") == F.col("own_content"))
    rows = rows.select(F.col("group").alias("band"), F.greatest("pieces", F.lit(1)).alias("pieces"), "rep", "fp", "fp2", "hashes")
    links = checkpointed(_met(rows).mapInArrow(_similar(similarity, SET_RADIUS), "a long, b long"))
    # A repeated doc_id may have several sets, which its id holds together.
    own = signed.join(reps.select("content", "rep"), "content").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    components = connected_components(links.union(subset_links(reps)).union(own))
    return signed.select("doc_id").distinct().join(components, F.col("doc_id") == F.col("vertex"), "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = SET_WORDS) -> DataFrame:
    """The rows of ``docs`` but those of documents whose group of near copies has a smaller ``doc_id``.

    Rows without a ``doc_id`` stay.
    """
    gone = near_copies(docs, similarity, words).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
