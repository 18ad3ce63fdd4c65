"""Sequence packing by shortest-pack-first over the length histogram."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dense_rank_in_key, map_rows, short_batches

MAX_TOKENS = 2048
END_ID = 1
#: Chunks of text whose ids a worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Rows of the placement table up to which it is broadcast.
BROADCAST_ROWS = 200_000

_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_ODD_BLANKS = re.compile(r" \s| $|[\x1c-\x1f\x85]")


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[str], bytes]:
    """A function from text to its ids as little-endian 32-bit integers.

    ``vocabulary`` is a byte-level BPE file of the ``tokenizers`` library. Its ids
    are merge ranks, which a ``tiktoken`` encoding takes as they are. Text is cut
    before each space that precedes a non-blank; the pre-tokenizer never joins
    across such a cut, so each chunk is encoded once and remembered. Added tokens of
    the file are cut out first, each as its own id, and the parts between are texts
    of their own, as ``tokenizers`` does it.
    """
    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in model.get("added_tokens", [])}
    if any(t[flag] for t in model.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{vocabulary}: added tokens that take blanks or whole words only are not supported")
    marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    back = byte_characters()
    ranks = {bytes(back[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    bpe = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, bytes] = {}

    def ids(chunk: str) -> bytes:
        return np.array(bpe.encode_ordinary(chunk), "<u4").tobytes()

    def encode(text: str) -> bytes:
        if marks and marks.search(text):
            return b"".join(special[p] if n % 2 else plain(p) for n, p in enumerate(marks.split(text)))
        return plain(text)

    def plain(text: str) -> bytes:
        if len(known) > REMEMBERED:
            known.clear()
        if _ODD_BLANKS.search(text):
            if re.search(r"[\x1c-\x1f\x85]", text):  # blanks on which the two libraries differ
                return ids(text)
            parts = _CHUNK.findall(text)
        else:
            head, *tail = text.split(" ")
            parts = [head, *[" " + t for t in tail]] if head else [" " + t for t in tail]
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            for p in parts:
                if p not in known:
                    known[p] = ids(p)
            return b"".join([known[p] for p in parts])

    return encode


def cut_documents(docs: DataFrame, vocabulary: str, size: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of each row of ``docs(doc_id, text)``: full sequences, then the rest.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens`` and with ``with_ids``
    the piece's ids. A null or empty text is the closing id alone.
    """
    close = np.array([END_ID], "<u4").tobytes()
    width = 4 * size

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(vocabulary)
        rows = []
        for part in short_batches(batch, 1):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = encode(text or "") + close
                for i in range(0, len(raw), width):
                    piece = raw[i : i + width]
                    rows.append((doc, i // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4, piece if with_ids else None))
        *made, ids = (pa.array(c) for c in zip(*rows, strict=True))
        made = [c.cast(pa.int64()) for c in made]
        ids = [pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in ids.to_pylist()], pa.list_(pa.int32()))] if with_ids else []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
        return pa.RecordBatch.from_arrays([*made, *ids], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, per_batch)


def shortest_pack_first(histogram: dict[int, int], size: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how many sequences follow each.

    Lengths are placed longest first, each into the pack with the least in it if it
    fits, else into a new one. Packs with the same lengths are one pattern with a
    count, so the work follows the number of distinct lengths, not of pieces.
    """
    open_by_room: dict[int, dict[tuple[int, ...], int]] = {}
    done: dict[tuple[int, ...], int] = {}
    widest = 0

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        nonlocal widest
        into = open_by_room.setdefault(room, {}) if room else done
        into[pattern] = into.get(pattern, 0) + count
        widest = max(widest, room)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while widest and not open_by_room.get(widest):
                widest -= 1
            if widest < length:  # a new pack is the one with the least in it until it is full
                each = size // length
                if left >= each:
                    put(size - each * length, (length,) * each, left // each)
                if left % each:
                    put(size - left % each * length, (length,) * (left % each), 1)
                break
            pattern, count = open_by_room[widest].popitem()
            used = min(left, count)
            if used < count:
                open_by_room[widest][pattern] = count - used
            put(widest - length, (*pattern, length), used)
            left -= used
    for room in sorted(open_by_room):
        for pattern, count in open_by_room[room].items():
            done[pattern] = done.get(pattern, 0) + count
    return sorted(done.items(), reverse=True)


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first_rank, end_rank, first_sequence, offset)``: who of a length goes where."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            out.append((length, rank, rank + count, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return out


def pack_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    size: int = MAX_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all rows of ``docs`` with ``sequence_id`` and ``offset``.

    Only the histogram of piece lengths, at most ``size`` rows, comes to the
    driver. Pieces are ranked within their length without a task that holds a
    whole length, and a rank falls into one range of the placement table. That
    table has about as many rows as there are patterns times their lengths; it is
    broadcast up to ``BROADCAST_ROWS`` rows and joined by a shuffle beyond that.
    Repeated rows are packed each. No rows give no rows.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    pieces = checkpointed(cut_documents(docs, vocabulary, size, with_ids))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = placements(shortest_pack_first(histogram, size))
    where = docs.sparkSession.createDataFrame(placed, "p_length long, low long, high long, first long, offset long")
    if len(placed) <= BROADCAST_ROWS:
        where = F.broadcast(where)
    ranked = dense_rank_in_key(pieces, "length", ["doc_id", "start", "ids_crc32", "doc_tokens"], "rank")
    joined = ranked.join(where, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return joined.select(
        *["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
        (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"),
        "offset",
        *["ids"] * with_ids,
    )
