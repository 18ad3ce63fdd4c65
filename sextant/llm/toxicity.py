"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, learned from document labels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches
from .words import Words, byte_kinds, cut_at_ends, words_of

ENDS = b".!?\n\r"
#: Every byte below 128 but letters, digits and the ends of sentences separates words.
KINDS = byte_kinds(bytes(b for b in range(128) if not chr(b).isalnum() and b not in ENDS), ENDS)
STEMS = range(3, 9)


@dataclass(frozen=True)
class Fit:
    """The bounded sample the classifier is fitted on, and how.

    Of the labelled documents that aren't held out and have at most ``most_bytes`` bytes,
    up to ``toxic`` toxic ones and ``clean`` others are taken, by the hash of their id.
    """

    toxic: int = 1500
    clean: int = 3000
    most_bytes: int = 32 << 10
    features: int = 2048
    least_docs: int = 6
    steps: int = 400
    rate: float = 0.05
    shrink: float = 1e-4


@dataclass(frozen=True)
class Model:
    """Weights of word stems and whole words, and of a sentence that has none of them."""

    weights: dict[str, float]
    bias: float

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))


def features_of(word: str) -> Iterator[str]:
    """A word's beginnings of 3 to 8 letters, and the whole word with a mark at its end."""
    yield f"{word}$"
    for n in STEMS:
        if n > len(word):
            return
        yield word[:n]


def held_out(doc_id: Column) -> Column:
    """Whether no label of the document may be learned: crc32 of its id modulo 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _texts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in short_batches(batch, column):
            if part.num_rows:
                yield part, part.column(column).cast(pa.binary()).to_pylist()


def _lowered(texts: list[bytes]) -> tuple[Words, list[str]]:
    """The words of ``texts`` with their names in lower case, each name once."""
    words = words_of(texts, KINDS)
    named = pa.array([w.decode("utf-8", "replace").lower() for w in words.names], pa.string()).dictionary_encode()
    places = np.asarray(named.indices).astype(np.int64)
    return words._replace(ids=places[words.ids] if len(places) else words.ids), named.dictionary.to_pylist()


def _distinct(sentence: np.ndarray, word: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word of a sentence once."""
    code = np.unique(sentence * names + word)
    return code // max(names, 1), code % max(names, 1)


def fit_model(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """A model from the labels in ``labels(doc_id, toxic)``, those that are held out left unread.

    Stems that tell toxic documents of the sample from others most clearly become the
    features. Then a sentence's score is the logistic function of their weights, a
    document's one minus the product of its sentences' complements, and the weights
    follow the gradient of the documents' likelihood; classes weigh as they do among
    all labelled documents. Conflicting labels count as toxic. Without labels of both
    kinds the model gives every sentence the share of toxic documents.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    each = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    total = {r["toxic"]: r["n"] for r in each.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    prior = Model({}, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    if len(total) < 2:
        return prior
    order = F.xxhash64("doc_id")
    chosen = each.where("toxic = 1").orderBy(order, "doc_id").limit(fit.toxic).union(each.where("toxic = 0").orderBy(order, "doc_id").limit(fit.clean))
    ids = F.broadcast(chosen.withColumnRenamed("doc_id", "id"))  # fit.toxic + fit.clean rows at most
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = docs.select("doc_id", text.alias("text")).join(ids, F.col("doc_id") == F.col("id"))
    rows = sample.where(F.octet_length("text") <= fit.most_bytes).select("text", "toxic").toArrow()
    texts = rows.column("text").cast(pa.binary()).to_pylist()
    toxic = np.asarray(rows.column("toxic").to_pylist(), np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return prior
    return _fitted(texts, toxic, total, fit)


def _fitted(texts: list[bytes], toxic: np.ndarray, total: dict[int, int], fit: Fit) -> Model:
    words, names = _lowered(texts)
    doc, word = _distinct(words.row, words.ids, len(names))
    in_toxic = np.bincount(word, toxic[doc], len(names))
    in_all = np.bincount(word, minlength=len(names))
    of_word = [list(features_of(n)) for n in names]
    lengths = np.fromiter(map(len, of_word), np.int64, len(of_word))
    encoded = pa.array([f for features in of_word for f in features], pa.string()).dictionary_encode()
    ids, known = np.asarray(encoded.indices).astype(np.int64), encoded.dictionary
    pos, neg = int(toxic.sum()), len(toxic) - int(toxic.sum())
    a = np.minimum(np.bincount(ids, np.repeat(in_toxic, lengths), len(known)), pos)
    every = np.bincount(ids, np.repeat(in_all, lengths), len(known))
    p, q = (a + 0.5) / (pos + 1), (np.minimum(every - a, neg) + 0.5) / (neg + 1)
    tells = np.where(every >= fit.least_docs, np.abs(np.log(p / q)) * np.abs(p - q), 0)
    best = np.argsort(-tells, kind="stable")[: fit.features]
    best = best[tells[best] > 0]
    column = dict(zip(known.take(pa.array(best)).to_pylist(), range(len(best)), strict=True))
    place = np.full(len(known), -1)
    place[best] = np.arange(len(best))
    used = place[ids] >= 0
    counts = np.bincount(np.repeat(np.arange(len(names)), lengths)[used], minlength=len(names))
    flat = place[ids][used]
    first = np.cumsum(counts) - counts

    # Sentences: those with a feature as rows of a sparse matrix, the others as a number per document.
    sentence, at = np.unique(words.piece, return_inverse=True)
    doc_of = np.zeros(len(sentence), np.int64)
    doc_of[at] = words.row
    where, word = _distinct(at, words.ids, len(names))
    n = counts[word]
    cells = np.repeat(where, n)
    features = flat[np.repeat(first[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if n.sum() else flat[:0]
    filled, cells = np.unique(cells, return_inverse=True)
    doc_of_filled = doc_of[filled]
    empty = np.bincount(doc_of, minlength=len(texts)) - np.bincount(doc_of_filled, minlength=len(texts))
    empty[np.bincount(words.row, minlength=len(texts)) == 0] = 1
    kinds = np.where(toxic == 1, total[1] / pos, total[0] / neg)
    weight = kinds / kinds.sum()

    theta, bias = np.zeros(len(column)), -4.0
    moment, scale = np.zeros(len(column) + 1), np.zeros(len(column) + 1)
    for step in range(1, fit.steps + 1):
        z = bias + np.bincount(cells, theta[features], len(filled))
        z, p, p0 = np.clip(z, -30, 30), 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-bias))
        clear = np.bincount(doc_of_filled, np.logaddexp(0, z), len(texts)) + empty * np.logaddexp(0, bias)
        pull = weight * np.where(toxic == 1, -1 / np.expm1(np.clip(clear, 1e-9, 500)), 1.0)
        by_sentence = pull[doc_of_filled] * p
        slope = np.append(np.bincount(features, by_sentence[cells], len(theta)) + fit.shrink * theta, by_sentence.sum() + (pull * empty).sum() * p0)
        moment, scale = 0.9 * moment + 0.1 * slope, 0.99 * scale + 0.01 * slope**2
        move = fit.rate * moment / (1 - 0.9**step) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
        theta, bias = theta - move[:-1], float(bias - move[-1])
    return Model({f: float(theta[i]) for f, i in column.items() if abs(theta[i]) > 1e-6}, bias)


def sentence_scores(texts: list[bytes], model: Model) -> tuple[np.ndarray, ...]:
    """Of each sentence with words: its text's number, first and last byte, and its log odds."""
    words, names = _lowered(texts)
    of_word = np.fromiter(map(model.word, names), float, len(names))
    _, first, at = np.unique(words.piece, return_index=True, return_inverse=True)
    where, word = _distinct(at, words.ids, len(of_word))
    odds = model.bias + np.bincount(where, of_word[word], len(first))
    last = np.append(first[1:], len(words.piece))[: len(first)] - 1
    return words.row[first], words.start[first], words.end[last], np.clip(odds, -30, 30)


SCORES = "score double, n_sentences long, worst_start long, worst_end long, offending array<struct<start:long,end:long,score:double>>"


def score_toxicity(docs: DataFrame, model: Model, sure: float = 0.5) -> DataFrame:
    """``(doc_id, score, n_sentences, worst_start, worst_end, offending)`` of each row of ``docs(doc_id, text, ...)``.

    ``score`` is the noisy-or of the sentences: one minus the product of their
    complements. ``offending`` has the sentences of a score of ``sure`` or more and
    ``worst_*`` the highest of all, the first of several; both are code points, end
    exclusive, from the first word to the last. A text without words, null included,
    counts as one sentence without features and has no worst one. Each row is scored by
    itself, whatever its length; repeated rows get the same scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # Fit.features weights at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, 1):
            if len(texts) == 1:
                parts = list(cut_at_ends(texts[0], ENDS))
                starts = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
                found = [sentence_scores([p], shared.value) for p in parts]
                row = np.concatenate([f[0] for f in found])
                start, end = (np.concatenate([f[i] + s for f, s in zip(found, starts, strict=True)]) for i in (1, 2))
                odds = np.concatenate([f[3] for f in found])
            else:
                row, start, end, odds = sentence_scores(texts, shared.value)
            clear = np.bincount(row, np.logaddexp(0, odds), len(texts)).astype(float)
            n = np.bincount(row, minlength=len(texts))
            clear[n == 0] = np.logaddexp(0, shared.value.bias)
            score = -np.expm1(-clear)
            worst: list[tuple[int | None, int | None]] = [(None, None)] * len(texts)
            told: list[list[dict]] = [[] for _ in texts]
            order = np.lexsort((start, -odds, row))
            first = order[np.unique(row[order], return_index=True)[1]] if len(order) else order
            sentence = 1 / (1 + np.exp(-odds))
            for i in {*first.tolist(), *np.flatnonzero(sentence >= sure).tolist()}:
                r = int(row[i])
                a = len(texts[r][: start[i]].decode("utf-8", "replace"))
                b = a + len(texts[r][start[i] : end[i]].decode("utf-8", "replace"))
                if sentence[i] >= sure:
                    told[r].append({"start": a, "end": b, "score": float(sentence[i])})
            for i in first.tolist():
                r = int(row[i])
                a = len(texts[r][: start[i]].decode("utf-8", "replace"))
                worst[r] = (a, a + len(texts[r][start[i] : end[i]].decode("utf-8", "replace")))
            for t in told:
                t.sort(key=lambda s: s["start"])
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            columns = [batch.column(0), score, n, [w[0] for w in worst], [w[1] for w in worst], told]
            kinds = [None, pa.float64(), pa.int64(), pa.int64(), pa.int64(), spans]
            yield pa.RecordBatch.from_arrays([c if k is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, {SCORES}")


NAMES = ["score", "n_sentences", "worst_start", "worst_end", "offending"]


def toxicity_digest(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """``(doc_id, held_out, score, predicted, ...)`` of all rows of ``docs``, by a model fitted on ``labels``."""
    scored = score_toxicity(docs, fit_model(docs, labels, fit))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "worst_start", "worst_end", F.size("offending").alias("n_offending"))
