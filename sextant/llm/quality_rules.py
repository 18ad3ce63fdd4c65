"""Quality rules by compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import by_place, checkpointed, map_rows, with_names

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Bands:
    """Limits of compressed over raw bytes: between two lengths they go with the length's logarithm.

    Short texts compress badly whatever they say, so both limits fall with length. A
    document also fails if over ``chunk_share`` of its bytes are in chunks outside their
    limits: ``chunk_low`` and ``chunk_high`` for those of ``chunk`` bytes, the limits for
    its length for a shorter last one. So every byte lies in a chunk that is judged.
    These limits are the ones without labels, wide enough for any prose, so they reject
    little but base64 and endless repetition; ``fit_bands`` takes narrower ones from
    labelled documents.
    """

    sizes: tuple[int, ...] = (1, 64, 128, 256, 512, 1024, 4096, 16384, 65536)
    low: tuple[float, ...] = (0.0, 0.45, 0.38, 0.30, 0.25, 0.22, 0.16, 0.12, 0.10)
    high: tuple[float, ...] = (30.0, 1.20, 1.02, 0.92, 0.82, 0.76, 0.72, 0.70, 0.70)
    chunk: int = 4096
    chunk_low: float = 0.18
    chunk_high: float = 0.74
    chunk_share: float = 0.25
    level: int = 3

    def of(self, size: int) -> tuple[float, float]:
        at = np.log2(self.sizes)
        x = np.log2(max(size, 1))
        return float(np.interp(x, at, self.low)), float(np.interp(x, at, self.high))


@dataclass(frozen=True)
class Fit:
    """How the limits are taken from labelled documents.

    All good ones count but those with crc32 of the id modulo 5 equal to 0, which are for
    reports. There is a length class for every ``per_class`` of them, ``classes`` at most. A
    class' limits leave out ``tail`` of its good documents on each side, a chunk's
    ``chunk_tail`` of their chunks, and are then moved outwards by ``margin``, as the next
    documents are never just like the last. Texts of over twice the longest length of the
    good ones, or under half the first class', go by limits that widen to those without labels.

    Documents are counted by length class and ratio, lengths in ``steps`` to a doubling
    and ratios in ``grain`` to 1, so what is collected is bounded however many there are.
    """

    per_class: int = 250
    classes: int = 64
    tail: float = 0.002
    chunk: int = 1024
    chunk_tail: float = 0.001
    margin: float = 0.01
    steps: int = 64
    grain: int = 10_000


def packed_sizes(raw: bytes, chunk: int, packer: zstandard.ZstdCompressor) -> tuple[int, list[int]]:
    """Compressed lengths of the text and of each chunk, the last one shorter."""
    return len(packer.compress(raw)), [len(packer.compress(raw[i : i + chunk])) for i in range(0, len(raw), chunk)]


def verdict(size: int, packed: int, chunks: list[int], bands: Bands) -> tuple[float | None, float, bool]:
    """The whole text's ratio, the share of its bytes in chunks outside their limits, and whether both will do."""
    if not size:
        return None, 0.0, False
    outside = 0
    for i, length in enumerate(chunks):
        cut = min(bands.chunk, size - i * bands.chunk)
        low, high = (bands.chunk_low, bands.chunk_high) if cut == bands.chunk else bands.of(cut)
        outside += 0 if low <= length / cut <= high else cut
    ratio, share = packed / size, outside / size
    low, high = bands.of(size)
    return ratio, share, low <= ratio <= high and share <= bands.chunk_share


MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, size long, packed long, chunks array<int>"


def measure_documents(docs: DataFrame, chunk: int = Fit.chunk, level: int = Bands.level) -> DataFrame:
    """For each row of ``docs(doc_id, text, ...)`` its id, the word measures, and the lengths in bytes of
    the text (``size``), compressed (``packed``), and of its ``chunks`` compressed: numbers only."""
    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([frame.schema["doc_id"], *StructType.fromDDL(MEASURED).fields])

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor(level=level)
        rows = []
        for value in batch.column(1):
            *measures, raw = text_measures(value.as_py())
            rows.append((*measures, len(raw), *(packed_sizes(raw, chunk, packer) if raw else (0, []))))
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
        made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *made], names=schema.names)

    return map_rows(frame, schema, per_batch, text=1)


Count = tuple[np.ndarray, np.ndarray, np.ndarray]


def _tally(good: DataFrame, of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Count:
    """Groups, values and how often each occurs in ``good(size, packed)``, in order; ``of`` gives both for each row, as whole numbers."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs, n = np.unique(np.stack(of(batch.column(0).to_numpy(), batch.column(1).to_numpy()), axis=1).astype(np.int64), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (pairs[:, 0], pairs[:, 1], n)], names=["part", "value", "n"])

    counted = map_rows(good.select("size", "packed"), "part long, value long, n long", per_batch)
    found = counted.groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow().sort_by([("part", "ascending"), ("value", "ascending")])
    return tuple(found.column(c).to_numpy() for c in ("part", "value", "n"))


def _quantile(values: np.ndarray, n: np.ndarray, q: float) -> float:
    """``np.quantile`` of the ascending values, each ``n`` times."""
    upto = np.cumsum(n)
    place = q * (upto[-1] - 1)
    below, above = values[np.searchsorted(upto, [np.floor(place), np.ceil(place)], side="right")]
    return float(below + (place - np.floor(place)) * (above - below))


def _class_starts(n: np.ndarray, least: int) -> list[int]:
    """Where each class starts: runs with a sum of ``least`` at least, what is left over going to the last."""
    starts, held = [0], 0
    left = int(n.sum())
    for i, k in enumerate(n):
        if held >= least and left >= least:
            starts.append(i)
            held = 0
        held += int(k)
        left -= int(k)
    return starts


def fit_measured(measured: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Bands:
    """Limits that the good documents of ``labels(doc_id, quality)`` keep, ``Bands()`` if there are under ``per_class``.

    All rows of ``measured`` that are labelled good, not held out, and pass the word rules
    are counted; the counts are collected. Rows without id or quality are passed over.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    ids = known.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("id")
    passing = measured.where(f"size > 0 and n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    good = checkpointed(passing.join(ids, F.col("doc_id") == F.col("id")).select("size", "packed", "chunks"))

    def step(size: np.ndarray) -> np.ndarray:
        return np.floor(np.log2(size) * fit.steps)

    _, steps, n = _tally(good, lambda size, packed: (np.zeros(len(size)), step(size)))
    total = int(n.sum())
    if total < fit.per_class:
        return Bands()
    starts = _class_starts(n, max(fit.per_class, -(-total // fit.classes)))
    cuts = steps[starts[1:]]
    parts = list(zip(starts, [*starts[1:], len(n)], strict=True))
    at = np.array([(_quantile(steps[i:j], n[i:j], 0.5) + 0.5) / fit.steps for i, j in parts])

    def by_class(line: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each class the ratios above ``line``, which goes over ``at``, and their counts."""

        def of(size: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.searchsorted(cuts, step(size), side="right"), np.rint((packed / size - np.interp(np.log2(size), at, line)) * fit.grain)

        group, value, n = _tally(good, of)
        return [(value[group == i] / fit.grain, n[group == i]) for i in range(len(at))]

    middle = np.array([_quantile(*x, 0.5) for x in by_class(np.zeros(len(at)))])
    # About the line of the medians, so that a class needn't be narrow.
    rest = by_class(middle)
    low = middle + [_quantile(*x, fit.tail) for x in rest] - fit.margin
    high = middle + [_quantile(*x, 1 - fit.tail) for x in rest] + fit.margin
    knots = np.unique(np.round(2**at).astype(int), return_index=True)
    wide = Bands()
    first = [(s, *wide.of(s)) for s in wide.sizes if s < min(64, knots[0][0] / 2)]
    longest = 2 * good.agg(F.max("size")).first()[0]
    last = [(longest, float(low[-1]), float(high[-1])), (2 * longest, *wide.of(2 * longest))]
    rows = [*first, *[(int(s), float(low[i]), float(high[i])) for s, i in zip(*knots, strict=True)], *last]
    whole_chunks = F.slice("chunks", 1, F.floor(F.col("size") / fit.chunk).cast("int"))
    found = good.select(F.explode(whole_chunks).alias("length")).groupBy("length").count().toArrow().sort_by("length")
    chunks, n = (found.column(c).to_numpy() for c in ("length", "count"))
    chunk_low, chunk_high = 0.0, 9.0
    if n.sum() >= 1 / fit.chunk_tail:
        chunk_low = _quantile(chunks, n, fit.chunk_tail) / fit.chunk - fit.margin
        chunk_high = _quantile(chunks, n, 1 - fit.chunk_tail) / fit.chunk + fit.margin
    return Bands(*zip(*rows, strict=True), chunk=fit.chunk, chunk_low=chunk_low, chunk_high=chunk_high)


def fit_bands(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Bands:
    """``fit_measured`` over ``docs(doc_id, text, ...)``. Texts are measured where they lie; only numbers are exchanged."""
    return fit_measured(measure_documents(docs, fit.chunk), labels, fit)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.uint64, len(words))
    if len(first) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x100000001B3) + (mixed[k : k + n] ^ (mixed[k : k + n] >> np.uint64(32)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_measures(text: str | None) -> tuple[int, int, int, int, int, bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the UTF-8 bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()] if b"\n" in raw else []
    dup = len(lines) - len(set(lines))
    return len(words), len(text or "") - blanks, symbols, dup, repeated_words(words), raw


def _fails(measures: list[int]) -> bool:
    """Whether the word rules reject a text of these measures."""
    return measures[0] < MIN_WORDS or 100 * measures[4] > MAX_REPEAT_PERCENT * measures[0]


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, ratio double, bad_chunks double"
)
KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2


def _scored(measures: list[int], size: int, packed: int, chunks: list[int], bands: Bands) -> tuple:
    """A row of ``MEASURES``."""
    failed = _fails(measures)
    ratio, outside, good = verdict(size, packed, chunks, bands)
    return *measures, failed, good and not failed, ratio, outside


def judge_measured(measured: DataFrame, bands: Bands) -> DataFrame:
    """What ``score_documents`` gives, from the rows of ``measure_documents`` with chunks of the bands' size."""
    schema = StructType([measured.schema["doc_id"], *StructType.fromDDL(MEASURES).fields])

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        *measures, size, packed, chunks = (c.to_pylist() for c in batch.columns[1:])
        rows = [_scored(m, *x, bands) for m, *x in zip(zip(*measures, strict=True), size, packed, chunks, strict=True)]
        made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *made], names=schema.names)

    return map_rows(measured, schema, per_batch)


def score_fitted(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """``score_documents`` by the limits of ``fit_bands``, each text compressed once: the measures are kept, then fitted and judged."""
    measured = checkpointed(measure_documents(docs, fit.chunk))
    bands = fit_measured(measured, labels, fit)
    return judge_measured(measured, bands) if bands.chunk == fit.chunk else score_documents(docs, bands)


def score_documents(docs: DataFrame, bands: Bands = Bands(), keep_rows: bool = False) -> DataFrame:
    """Measures and verdict for each row of ``docs(doc_id, text, ...)``.

    With ``keep_rows`` these are the rows of ``docs`` that are kept, as they are, whatever
    their columns are named. Else each row gives ``doc_id``, the word measures,
    ``base_failed``, ``kept``, ``ratio`` (compressed over raw bytes, null for an
    empty text) and ``bad_chunks`` (share of bytes in chunks outside their limits). Null and
    empty texts have no words and fail; every row is judged by itself, so repeated
    rows get the same verdict. Whole texts count, whatever their length.
    """
    docs = docs if keep_rows else docs.select("doc_id", "text")
    frame = by_place(docs, text=F.col("text").cast("string"))
    if not keep_rows:
        frame = frame.drop("c1")
    own = frame.drop("text").schema.fields
    schema = StructType([*own, *StructType.fromDDL(MEASURES).fields])

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor(level=bands.level)
        rows = []
        for value in batch.column(batch.num_columns - 1):
            *measures, raw = text_measures(value.as_py())
            packed = packed_sizes(raw, bands.chunk, packer) if raw else (0, [])
            rows.append(_scored(measures, len(raw), *packed, bands))
        made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    out = map_rows(frame, schema, per_batch, text=len(own))
    if keep_rows:
        return with_names(out.where("kept"), docs.columns)
    return out.select(F.col("c0").alias("doc_id"), *schema.names[1:])


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    return score_documents(docs, bands, keep_rows=True)
