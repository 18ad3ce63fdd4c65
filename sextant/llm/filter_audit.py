"""Filter interaction audit: which documents each filter removes, in every order of the filters.

Exact copies are found by routing fingerprints through an RDD; the failed filters of a
document are a mask, and per part the counts of the 32 masks hold all that the audit
needs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Texts of this many bytes are held before a task passes them on, and meet in a partition on average.
HELD, SHARE = 64 << 20, 16 << 20

#: A text's claim: the smallest id with it so far, its failed filters, rows per part with that id.
Claim = tuple[object, int, dict[str, int]]


def failed(text: str, raw: bytes) -> int:
    """The filters A to D that a text fails, as a mask: A is bit 0."""
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * upper > MOST_UPPER * len(text),
        len(raw) != len(raw.translate(None, SYMBOLS)),
    )
    return sum(1 << i for i, f in enumerate(fails) if f)


def _before(a: object, b: object) -> bool:
    """Whether id ``a`` is smaller than ``b``; null is larger than all others."""
    return a is not None and (b is None or a < b)


class Chains:
    """For each fingerprint a chain of the texts that have it, each with the smallest id's claim."""

    def __init__(self) -> None:
        self.size = 0
        self._chains: dict[int, list[list]] = {}

    def offer(self, fingerprint: int, raw: bytes, claim: Claim) -> Claim | None:
        """Take a text in; gives back the claim that a smaller id beats, if any."""
        chain = self._chains.setdefault(fingerprint, [])
        for link in chain:
            if link[0] == raw:
                break
        else:
            chain.append([raw, claim])
            self.size += len(raw) + 200
            return None
        held = link[1]
        if _before(claim[0], held[0]):
            link[1] = claim
            return held
        if _before(held[0], claim[0]):
            return claim
        for part, n in claim[2].items():
            held[2][part] = held[2].get(part, 0) + n
        return None

    def drain(self) -> Iterator[tuple[int, bytes, Claim]]:
        for fingerprint, chain in self._chains.items():
            for raw, claim in chain:
                yield fingerprint, raw, claim
        self._chains, self.size = {}, 0


def _beaten(claim: Claim) -> tuple[int, tuple[bytes | None, Claim]]:
    """A claim known to have failed, without its text and routed by its id."""
    doc, mask, parts = claim
    return xxhash.xxh64_intdigest(repr(doc)), (None, (doc, mask | COPY, parts))


def _routed(rows: Iterable[tuple]) -> Iterator[tuple[int, tuple[bytes | None, Claim]]]:
    """One claim per distinct text of the task; the rows that another of the task beats go without text."""
    chains = Chains()
    for doc, text, part in rows:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        lost = chains.offer(xxhash.xxh64_intdigest(raw), raw, (doc, failed(text, raw), {part: 1}))
        if lost:
            yield _beaten(lost)
        if chains.size > HELD:
            for fingerprint, held, claim in chains.drain():
                yield fingerprint, (held, claim)
    for fingerprint, held, claim in chains.drain():
        yield fingerprint, (held, claim)


def _settled(routed: Iterable[tuple[int, tuple[bytes | None, Claim]]]) -> Iterator[tuple[object, str, int, int]]:
    """``(doc_id, part, mask, rows)`` once all claims of a fingerprint have met."""
    chains = Chains()

    def rows(claim: Claim, more: int = 0) -> Iterator[tuple[object, str, int, int]]:
        doc, mask, parts = claim
        for part, n in parts.items():
            yield doc, part, mask | more, n

    for fingerprint, (raw, claim) in routed:
        if raw is None:
            yield from rows(claim)
        elif lost := chains.offer(fingerprint, raw, claim):
            yield from rows(lost, COPY)
    for _, _, claim in chains.drain():
        yield from rows(claim)


def failed_filters(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask, rows)``: the filters that each row of ``docs(doc_id, text, lang, ...)`` fails.

    Filter E fails for a text that a smaller ``doc_id`` has too, anywhere in the table. Rows
    are dealt by the xxhash of their text; where they meet, a chain per fingerprint keeps
    the full texts, so colliding fingerprints do no harm, with the smallest id of each.
    A task first settles its own rows, so that a text goes out once per task and the
    copies in a third of all rows make no large partition. All texts are measured first:
    there is a partition for every ``SHARE`` bytes of them, so what the chains of a task
    hold doesn't grow with the table. Rows of one text and id count together in
    ``rows``, null ids come after all others, a null text is empty, a null language the
    part ``''``.
    """
    kind = docs.schema["doc_id"].dataType
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    source = docs.select("doc_id", F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit(""))).rdd
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    routed: RDD = source.mapPartitions(_routed).partitionBy(max(shuffled, size // SHARE), lambda fingerprint: fingerprint)
    fields = [StructField("doc_id", kind), StructField("part", StringType()), StructField("mask", IntegerType()), StructField("rows", LongType())]
    return docs.sparkSession.createDataFrame(routed.mapPartitions(_settled), StructType(fields), verifySchema=False)


def _one(row: tuple) -> np.ndarray:
    """The mask count vectors of one row: all, good and toxic documents."""
    return _more(np.zeros((3, MASKS), np.int64), row)


def _more(counts: np.ndarray, row: tuple) -> np.ndarray:
    mask, n, good, toxic = row
    counts[0, mask] += n
    counts[1, mask] += n * good
    counts[2, mask] += n * toxic
    return counts


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def orders(counts: np.ndarray) -> Iterator[tuple[str, int, int, int, int, int, int, int, int]]:
    """A row per order and step from the mask counts of a part, its Shapley sums included."""
    masks = np.arange(MASKS)
    removed: dict[str, int] = dict.fromkeys(FILTERS, 0)
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, earlier = masks & bit > 0, masks & before > 0
            here = fails & ~earlier
            out = counts[:, here].sum(axis=1)
            removed[name] += int(out[0])
            before |= bit
            kept = counts[0, masks & before == 0].sum()
            rows.append((name, "".join(order), step, int(kept), int(out[0]), int(counts[0, fails & earlier].sum()), int(counts[0, bit]), int(out[1]), int(out[2])))
    for name, *row in rows:
        yield (*row, removed[name])


AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long,"
    " unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step, with the counts of documents there.

    ``labels(doc_id, quality, toxic, ...)`` say which documents are good or toxic; of
    several rows with one id, any that says so counts, and documents without one are
    neither. Counts are of rows, so repeated rows count each. A part is a value of
    ``lang``; a table without rows has no parts. See ``failed_filters`` for nulls.
    """
    told = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c) for c in ("quality", "toxic")])
    )
    marked = failed_filters(docs).join(told, F.col("doc_id") == F.col("id"), "left")
    good, toxic = (F.coalesce(c, F.lit(0)) for c in ("quality", "toxic"))
    pairs = marked.select("part", "mask", "rows", good, toxic).rdd.map(lambda r: (r[0], tuple(r[1:])))
    per_part = pairs.combineByKey(_one, _more, _both)
    return docs.sparkSession.createDataFrame(per_part.flatMap(lambda p: ((p[0], *row) for row in orders(p[1]))), AUDIT, verifySchema=False)


AUDIT_SQL = r"""
WITH told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), docs AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS body,
         regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(t.good, 0) AS good, coalesce(t.toxic, 0) AS toxic
  FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
), masked AS (
  SELECT part, good, toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN min(doc_id) OVER (PARTITION BY body) < doc_id THEN 16 ELSE 0 END AS mask
  FROM docs
), counted AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), filter_orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS earlier
  FROM (SELECT filter_order, bits, unnest([1, 2, 3, 4, 5]) AS step FROM filter_orders)
), audited AS (
  SELECT c.part, s.filter_order, s.step, s.bit,
         sum(CASE WHEN c.mask & (s.earlier + s.bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN c.mask & s.bit > 0 AND c.mask & s.earlier = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN c.mask & s.bit > 0 AND c.mask & s.earlier > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN c.mask = s.bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN c.mask & s.bit > 0 AND c.mask & s.earlier = 0 THEN c.good ELSE 0 END) AS good_lost,
         sum(CASE WHEN c.mask & s.bit > 0 AND c.mask & s.earlier = 0 THEN c.toxic ELSE 0 END) AS toxic_lost
  FROM counted c, steps s GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM audited
"""
