"""Words of a batch of texts as arrays, with no Python object per occurrence."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: What a byte is: part of a word, a blank between words, or the end of a piece.
WORD, BLANK, END = 0, 1, 2


class Words(NamedTuple):
    """Word occurrences in reading order, each with its name, piece, row and bytes."""

    ids: np.ndarray  # place in ``names``
    names: list[bytes]
    piece: np.ndarray  # number of piece ends before the word
    row: np.ndarray  # which of the texts
    start: np.ndarray  # first byte in its text
    end: np.ndarray


def byte_kinds(blanks: bytes, ends: bytes) -> np.ndarray:
    """The kind of each of the 256 bytes; what is in neither argument belongs to words."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(blanks)] = BLANK
    kinds[list(ends)] = END
    return kinds


def words_of(texts: list[bytes], kinds: np.ndarray, fold: bytes | None = None) -> Words:
    """The words of all ``texts``, whose bytes ``fold`` translates first; a text's end is a piece's end.

    ``kinds`` must make the line feed, by which texts are joined, the end of a piece.
    """
    data = b"\n".join(texts)
    data = data.translate(fold) if fold else data
    buffer = np.frombuffer(data, np.uint8)
    kind = kinds[buffer]
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = kind == WORD
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    packed = buffer[kind == WORD]
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    encoded = column.dictionary_encode()
    first = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=first[1:])
    row = np.searchsorted(first, start, "right") - 1
    piece = np.cumsum(kind == END)[start] if len(start) else start
    return Words(np.asarray(encoded.indices).astype(np.int64), encoded.dictionary.to_pylist(), piece, row, start - first[row], end - first[row])


def cut_at_ends(raw: bytes, ends: bytes, limit: int = 4 << 20) -> Iterator[bytes]:
    """``raw`` in parts of about ``limit`` bytes, cut at piece ends only, so no piece is split."""
    at = 0
    while len(raw) - at > limit:
        cut = max(raw.rfind(bytes([e]), at, at + limit) for e in ends)
        if cut < 0:
            found = [i for e in ends if (i := raw.find(bytes([e]), at + limit)) >= 0]
            if not found:
                break
            cut = min(found)
        yield raw[at:cut]
        at = cut + 1
    yield raw[at:]
