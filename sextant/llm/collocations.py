"""Phrase collocations: merged count-min sketches propose n-grams, an exact second pass decides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, short_batches
from .words import Words, byte_kinds, cut_at_ends, words_of

ENDS = b".,;:!?\n\x0b\x0c\r"
KINDS = byte_kinds(b" \t", ENDS)
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ROWS = 2
BLOCK = 1 << 16
#: Bytes of text that are worked on at a time.
PART = 1 << 20


@dataclass(frozen=True)
class Mining:
    """What is mined, and how wide the sketches are.

    A row of a sketch has a cell for every ``bytes_per_cell`` bytes of text, a power of
    two up to ``1 << most_bits``. It only overestimates, so a narrow sketch lets more
    through to the exact pass and loses nothing; with the bound, beyond some
    gigabytes of text it saves less, and what a task holds (256 MB) and what is
    broadcast (8 MB) stay as they are.
    """

    least: int = 100
    longest: int = 5
    top: int = 2000
    covered: int = 100
    bytes_per_cell: int = 128
    most_bits: int = 25


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Sketch:
    """Cells that hold, or bits that mark, how often hashed n-grams occur."""

    def __init__(self, bits: int, marks: bytes | None = None) -> None:
        self.bits = bits
        self.cells = np.zeros((ROWS, 1 << bits), np.uint32) if marks is None else None
        self.marks = None if marks is None else np.frombuffer(marks, np.uint8).reshape(ROWS, -1)

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        for row in range(ROWS):
            yield ((hashes >> np.uint64(32 * row)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for cells, places in zip(self.cells, self._places(hashes), strict=True):
            np.add.at(cells, places, np.uint32(1))

    def often(self, hashes: np.ndarray) -> np.ndarray:
        """Whether all rows mark the n-gram: true for each that is frequent, and for some others."""
        found = np.ones(len(hashes), bool)
        for marks, places in zip(self.marks, self._places(hashes), strict=True):
            found &= (marks[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0
        return found

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """The cells in compressed blocks, none for blocks of zeros; a count over 255 is given as 255."""
        packer, size = zstandard.ZstdCompressor(level=1), min(BLOCK, 1 << self.bits)
        for number, part in enumerate(self.cells.reshape(-1, size)):
            if part.any():
                yield number, packer.compress(np.minimum(part, 255).astype(np.uint8).tobytes())


#: Sketches of n-grams: their lengths, and the marks of the cells that are frequent, if known.
Known = list[tuple[range, int, bytes]]


def _frequent(words: Words, of_row: np.ndarray, longest: int, known: list[tuple[range, Sketch]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1: hashes of the n-grams that start at each word, and which of them can be frequent.

    Those are inside one piece, begin and end with shorter ones that can be frequent, and
    are marked by the sketch of their length, if it is known.
    """
    names = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.names), np.uint64, len(words.names))
    of_word = names[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    hashes = _mixed(of_row[words.row] + np.uint64(0x9E3779B97F4A7C15))
    n, stay = len(of_word), np.ones(len(of_word) + 1, bool)
    for k in range(1, longest + 1):
        if n < k:
            return
        hashes = _mixed(hashes[: n - k + 1] * np.uint64(0x100000001B3) + of_word[k - 1 :])
        stay = stay[:-1] & stay[1:] & (words.piece[: n - k + 1] == words.piece[k - 1 :])
        for lengths, sketch in known:
            if k in lengths:
                stay[stay] = sketch.often(hashes[stay])
        yield hashes, stay


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and languages of about ``PART`` bytes at a time; a long text in several parts, cut between pieces."""
    for batch in batches:
        for part in short_batches(batch, 0, PART):
            langs = part.column(1).to_pylist()
            texts = [b if isinstance(b, bytes) else b.encode() for b in part.column(0).cast(pa.binary()).to_pylist()]
            if len(texts) == 1:
                for cut in cut_at_ends(texts[0], ENDS, PART):
                    yield [cut], langs
            elif texts:
                yield texts, langs


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in langs), np.uint64, len(langs))


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
    )


def _merged(docs: DataFrame, bits: int, lengths: range, mining: Mining, known: Known) -> bytes:
    """Marks of the cells that reach ``least`` once the sketches of all tasks are added.

    Each task sketches its own rows, and the sums are made block by block where Spark
    puts the block. Only n-grams that can be frequent by the ``known`` sketches of shorter
    ones are added. The marks, a bit a cell, are all that the driver gets: 8 MB at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    least, blocks = mining.least, max(1, (1 << bits) // BLOCK)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Sketch(bits)
        shorter = [(of, Sketch(n, marks)) for of, n, marks in shared.value]
        for texts, langs in _parts(batches):
            words = words_of(texts, KINDS, FOLD)
            for k, (hashes, stay) in enumerate(_frequent(words, _lang_hashes(langs), lengths.stop - 1, shorter), 1):
                if k in lengths:
                    made.add(hashes[stay])
        rows = list(made.blocks())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "cells"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = np.frombuffer(unpack.decompress(cells), np.uint8)
                if block in sums:
                    sums[block] += cells
                else:
                    sums[block] = cells.astype(np.uint64)
        marks = [np.packbits(s >= least, bitorder="little").tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(marks, pa.binary())], names=["block", "marks"])

    found = docs.mapInArrow(sketch, "block int, cells binary").repartition("block").mapInArrow(add, "block int, marks binary")
    size = min(BLOCK, 1 << bits) // 8
    out = bytearray(size * blocks * ROWS)
    for row in found.collect():  # ROWS << bits marks at most
        out[row["block"] * size : (row["block"] + 1) * size] = row["marks"]
    return bytes(out)


def phrase_counts(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """``(lang, k, phrase, n)``: every phrase of 1 to ``longest`` words that occurs ``least`` times, and ``k`` 0 with all words.

    Passes over ``docs(text, lang, ...)``: sketches of the words, of the pairs of words
    that the first marks, and of the longer n-grams whose pairs are marked, then exact
    counts of the n-grams that all of these mark. The exact pass counts per batch by the
    words themselves, not by hashes, and Spark adds the counts by phrase, partly before
    the exchange.
    """
    rows = _read(docs)
    size = rows.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    bits = min(mining.most_bits, max(17, (size // mining.bytes_per_cell).bit_length()))
    longest = mining.longest
    known: Known = []
    for lengths, width in ((range(1, 2), bits - 1), (range(2, 3), bits), (range(3, longest + 1), bits - 1)):
        if lengths:
            known.append((lengths, width, _merged(rows, width, lengths, mining, known)))
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [(lengths, Sketch(width, marks)) for lengths, width, marks in shared.value]
        for texts, langs in _parts(batches):
            words = words_of(texts, KINDS, FOLD)
            if not len(words.ids):
                continue
            names = sorted(set(langs))
            of_row = np.searchsorted(names, langs)
            lang = of_row[words.row]
            out = [(names[i], 0, "", int(n)) for i, n in enumerate(np.bincount(lang, minlength=len(names))) if n]
            codes = words.ids
            spelled = {}
            for k, (_, stay) in enumerate(_frequent(words, _lang_hashes(langs), longest, sketches), 1):
                key = (lang if k == 1 else codes[: len(stay)]) * len(words.names) + words.ids[k - 1 :]
                at = np.flatnonzero(stay)
                if not len(at):
                    break
                _, first, code, n = np.unique(key[at], return_index=True, return_inverse=True, return_counts=True)
                codes = np.zeros(len(stay), np.int64)
                codes[at] = code
                for i, times in zip(at[first].tolist(), n.tolist(), strict=True):
                    parts = words.ids[i : i + k].tolist()
                    for w in parts:
                        if w not in spelled:
                            spelled[w] = words.names[w].decode("utf-8", "surrogatepass")
                    out.append((names[lang[i]], k, " ".join([spelled[w] for w in parts]), times))
            columns = zip(*out, strict=True)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "k", "phrase", "n"])

    found = rows.mapInArrow(count, "lang string, k int, phrase string, n long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= mining.least) | (F.col("k") == 0))


def _slice(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _scored(counts: DataFrame) -> DataFrame:
    """Candidates with the counts of the two parts of their lowest-scoring cut and its score."""
    totals = counts.where("k = 0").select("lang", F.col("n").alias("words"))
    phrases = counts.where("k > 0").select("lang", "phrase", F.col("n").alias("f"))
    words = F.split("phrase", " ", -1)
    cuts = counts.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = cuts.select(
        "lang", "k", "phrase", "a", "cut", _slice(words, F.lit(1), F.col("cut")).alias("head"), _slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail")
    )
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    small = totals.count() <= 100_000  # languages; a row of each is broadcast only then
    whole = parts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(F.broadcast(totals) if small else totals, "lang")
    score = F.expr("(1000BD * cast(a as decimal(15,0)) * cast(words as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = F.min(F.struct(score.alias("score"), F.col("cut"), F.col("l"), F.col("r"))).alias("best")
    return whole.groupBy("lang", "k", "phrase", "a", F.col("words").alias("n")).agg(best).select("lang", "k", "phrase", "a", "n", "best.score", "best.l", "best.r")


def _covered(counts: DataFrame) -> DataFrame:
    """For each phrase inside a longer candidate, the count of the most frequent of these: ``(lang, phrase, longer)``."""
    words = F.split("phrase", " ", -1)
    lengths = F.sequence(F.lit(2), F.col("k") - 1)
    starts = F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _slice(words, i, m)))
    inside = counts.where("k > 2").select("lang", F.explode(F.array_distinct(F.flatten(starts))).alias("phrase"), F.col("n"))
    return inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def mine_collocations(docs: DataFrame, mining: Mining = Mining(), buckets: int = 64) -> DataFrame:
    """Each language's first ``top`` phrases: ``(lang, rank, phrase, a, l, r, n, score)``.

    Rows of ``docs(text, lang, ...)`` all count, repeated ones too; ``doc_id`` isn't
    read, other columns neither. A null text is empty, a null language ``und``. Phrases
    lie inside pieces between punctuation marks or line ends. ``a`` is a phrase's count,
    ``l`` and ``r`` those of its parts at the cut of the lowest score, ``n`` all words of
    the language. A phrase inside a longer candidate with at least ``covered`` per cent
    of its count is dropped. Ties in the score go by count, then by phrase. No rows, or
    no phrase that is frequent, give none. Ranking is done in ``buckets`` parts of each
    language first, so the last step sorts ``buckets * top`` rows of a language.
    """
    counts = checkpointed(phrase_counts(docs, mining))
    scored = _scored(counts).join(_covered(counts), ["lang", "phrase"], "left")
    stay = scored.where(F.coalesce(100 * F.col("longer") < mining.covered * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(buckets))
    first = stay.withColumn("bucket", bucket).withColumn("place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order)))
    last = first.where(F.col("place") <= mining.top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return last.where(F.col("rank") <= mining.top).select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), spoken AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM spoken GROUP BY lang
), grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM spoken, (SELECT unnest([1, 2, 3, 4, 5]) AS k) AS lengths WHERE len(w) >= k)
), f AS (
  SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g HAVING count(*) >= 100
), cuts AS (
  SELECT lang, k, g, a, cut, g[1:cut] AS head, g[cut + 1:k] AS tail
  FROM (SELECT lang, k, g, a, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1)
), scored AS (
  SELECT c.lang, c.k, c.g, c.a, c.cut, h.a AS l, t.a AS r, n.n,
         (1000::HUGEINT * c.a * n.n) // (h.a::HUGEINT * t.a) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.g = c.head
              JOIN f t ON t.lang = c.lang AND t.g = c.tail
              JOIN totals n ON n.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer
  FROM (SELECT lang, k, g, a, m, unnest(generate_series(1, k - m + 1)) AS i
        FROM f, (SELECT unnest([2, 3, 4]) AS m) AS lengths WHERE k > m)
  GROUP BY ALL
), stay AS (
  SELECT s.*, array_to_string(s.g, ' ') AS phrase
  FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.g = s.g
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM stay QUALIFY rank <= 2000
"""
