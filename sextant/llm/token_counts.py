"""Token counts under a unigram model, by dynamic programming shared in a trie.

A document's pre-tokens are its words behind a word mark. Each task inserts the
distinct pre-tokens it meets in a trie. A node keeps the best forward score of its
prefix and the number of pieces on that path, found once however many pre-tokens
share the prefix; where a pre-token ends the count is stored, and a document's
tokens are the sum of its words' stored counts.
"""

from __future__ import annotations

import math
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, short_batches

#: The mark in front of a word in the vocabulary file.
MARK = "▁"
#: A trie of more nodes is started afresh; counts don't depend on it.
MOST_NODES = 500_000
#: Longer words are scored along a path that is not kept.
LONGEST_KEPT = 200


class Pieces:
    """A vocabulary with unigram log-probabilities.

    Pieces are in the file by rank, and a piece's probability is taken to fall with
    it by Zipf's law, 1 / rank; nothing is trained. A character that no piece covers
    is written as its UTF-8 bytes, each one token of the lowest score less 10.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        total = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
        self.score = {model.id_to_piece(i): -math.log(r) - total for r, i in enumerate(plain, 1)}
        self.byte = min(self.score.values()) - 10
        #: The pieces read backwards: ``(nodes below by character, score or None)``.
        self.backwards: list = [{}, None]
        for piece, score in self.score.items():
            node = self.backwards
            for c in reversed(piece):
                node = node[0].setdefault(c, [{}, None])
            node[1] = score


class Trie:
    """Pre-tokens with the forward score and the piece count of each prefix."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.counts: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.forward: list[tuple[float, int]] = [(0.0, 0)]
        self.counts.clear()

    def step(self, path: list[tuple[float, int]], word: str, end: int) -> tuple[float, int]:
        """The best score of ``word[:end]`` and minus its pieces, from those of the shorter prefixes.

        Equal scores take fewer pieces.
        """
        start = end - 1
        last = word[start]
        score, pieces = path[start]
        size = 1 if last < "\x80" else len(last.encode("utf-8", "surrogatepass"))
        score += size * self.pieces.byte
        pieces -= size
        node = self.pieces.backwards[0].get(last)
        while node:
            below, value = node
            if value is not None:
                before, fewer = path[start]
                before += value
                if before > score or (before == score and fewer - 1 > pieces):
                    score, pieces = before, fewer - 1
            start -= 1
            node = below.get(word[start]) if start >= 0 else None
        return score, pieces

    def count(self, word: str) -> int:
        """Pieces of the best path through ``word``."""
        if len(self.forward) > MOST_NODES:
            self.clear()
        node, path = 0, [self.forward[0]]
        keep = len(word) <= LONGEST_KEPT
        for end in range(1, len(word) + 1):
            if keep:
                below = self.children[node]
                node = below.get(word[end - 1], -1)
                if node < 0:
                    below[word[end - 1]] = node = len(self.forward)
                    self.children.append({})
                    self.forward.append(self.step(path, word, end))
                path.append(self.forward[node])
            else:
                path.append(self.step(path, word, end))
        if keep:
            self.counts[word] = -path[-1][1]
        return -path[-1][1]


@lru_cache(maxsize=2)
def _trie(path: str) -> Trie:
    return Trie(Pieces(path))


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens)`` for each row of ``docs(doc_id, text, ...)``.

    Pre-tokens are the words between white space (as ``str.split`` sees it). Null,
    empty and blank texts have none. Whole texts count; repeated rows come as often
    as they are given, other columns are ignored.
    """
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        trie = _trie(path)
        words, tokens = [], []
        for part in short_batches(batch, 1):
            for text in part.column(1):
                split = (text.as_py() or "").split()
                stored = trie.counts
                total = 0
                try:
                    total = sum([stored[MARK + w] for w in split])
                except KeyError:
                    total = sum(stored[w] if w in stored else trie.count(w) for w in [MARK + x for x in split])
                words.append(len(split))
                tokens.append(total)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(frame, "doc_id long, n_pretokens long, n_tokens long", per_batch)
