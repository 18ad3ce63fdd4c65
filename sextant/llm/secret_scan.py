"""Secret scans through a trigram inverted index.

Each rule's regular expression gives a Boolean query on trigrams: what a match has
to contain. Every segment of documents (a slice of an Arrow batch, in place, so no
text is shuffled) gets postings for the trigrams that the rules ask for. A rule's
query is answered by intersecting and uniting postings, and only the candidates are
searched with its expression. A rule without a mandatory trigram scans everything.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from re import _constants as ops
from re import _parser as regex_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, short_batches

#: A trigram, ("and" | "or", parts), or True for a query that every text answers.
Query = bytes | tuple | bool
#: Most literal strings followed side by side while a query is derived.
MOST_STRINGS = 48


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of ``group`` for a match to count."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The expressions of the contract, then public formats of well-known services.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
MORE_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("login_url", r"://[A-Za-z0-9._~-]{1,64}:[A-Za-z0-9._~!$&'*+,;=-]{1,128}@"),
)


def _both(a: Query, b: Query, kind: str) -> Query:
    if kind == "and":
        if a is True or b is True:
            return b if a is True else a
    elif a is True or b is True:
        return True
    return a if a == b else (kind, (a, b))


def _of_strings(strings: frozenset[bytes]) -> Query:
    """What a text has to contain to hold one of the strings."""
    query: Query | None = None
    for s in sorted(strings):
        one: Query = True
        for i in range(len(s) - 2):
            one = _both(one, s[i : i + 3], "and")
        query = one if query is None else _both(query, one, "or")
    return True if query is None else query


def _folded(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass").lower()


def _exact(item: tuple) -> frozenset[bytes] | None:
    """All strings, A-Z folded, that the item matches; None if there are many."""
    kind, arg = item
    if kind is ops.LITERAL:
        return frozenset([_folded(arg)])
    if kind is ops.AT:
        return frozenset([b""])
    if kind is ops.IN:
        out: set[bytes] = set()
        for k, v in arg:
            if k is ops.LITERAL:
                out.add(_folded(v))
            elif k is ops.RANGE and v[1] - v[0] < MOST_STRINGS:
                out |= {_folded(c) for c in range(v[0], v[1] + 1)}
            else:
                return None
        return frozenset(out) if len(out) <= 8 else None
    if kind is ops.SUBPATTERN:
        return _joined(arg[-1])
    if kind is ops.BRANCH:
        parts = [_joined(p) for p in arg[1]]
        return None if None in parts else frozenset().union(*parts)
    if kind is ops.MAX_REPEAT and arg[1] <= 3:
        one = _joined(arg[2])
        if one is None:
            return None
        return frozenset(b"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n))
    return None


def _joined(items) -> frozenset[bytes] | None:
    out = frozenset([b""])
    for item in items:
        more = _exact(item)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = frozenset(a + b for a in out for b in more)
    return out


def _derive(items) -> Query:
    query, run = True, frozenset([b""])
    for kind, arg in items:
        more = _exact((kind, arg))
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in more)
            continue
        query, run = _both(query, _of_strings(run), "and"), frozenset([b""])
        if more is not None:
            run = more
        elif kind is ops.SUBPATTERN:
            query = _both(query, _derive(arg[-1]), "and")
        elif kind is ops.BRANCH:
            either: Query | None = None
            for part in arg[1]:
                one = _derive(part)
                either = one if either is None else _both(either, one, "or")
            query = _both(query, True if either is None else either, "and")
        elif kind in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and arg[0] > 0:
            query = _both(query, _derive(arg[2]), "and")
    return _both(query, _of_strings(run), "and")


def trigram_query(pattern: str) -> Query:
    """What every match of ``pattern`` has to contain, in trigrams of UTF-8 bytes with A-Z folded."""
    return _derive(regex_parser.parse(pattern))


def trigrams_of(query: Query) -> set[bytes]:
    if isinstance(query, tuple):
        return set().union(*map(trigrams_of, query[1]))
    return {query} if isinstance(query, bytes) else set()


@dataclass(frozen=True)
class Compiled:
    rules: tuple[Rule, ...]
    patterns: tuple[re.Pattern[str], ...]
    queries: tuple[Query, ...]
    codes: np.ndarray
    pairs: np.ndarray


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> Compiled:
    queries = tuple(trigram_query(r.pattern) for r in rules)
    wanted = sorted(set().union(*map(trigrams_of, queries)))
    pairs = np.zeros(1 << 16, bool)
    pairs[[int.from_bytes(t[:2], "big") for t in wanted]] = True
    codes = np.array([int.from_bytes(t, "big") for t in wanted], np.int64)
    # The base kind "hex" is a maximal run, which the same expression with a least length finds too.
    patterns = tuple(r.compiled() if r.kind != "hex" else re.compile("[0-9a-f]{%d,}" % r.least) for r in rules)
    return Compiled(rules, patterns, queries, codes, pairs)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def postings(raw: np.ndarray, offsets: np.ndarray, made: Compiled) -> np.ndarray:
    """Of each wanted trigram, which documents of the segment have it."""
    found = np.zeros((len(made.codes), len(offsets) - 1), bool)
    if len(raw) < 3 or not len(made.codes):
        return found
    low = _LOWER[raw]
    pair = (low[:-2].astype(np.uint16) << 8) | low[1:-1]
    at = np.flatnonzero(made.pairs[pair])
    code = (pair[at].astype(np.int64) << 8) | low[at + 2]
    which = np.minimum(np.searchsorted(made.codes, code), len(made.codes) - 1)
    hit = made.codes[which] == code
    at, which = at[hit], which[hit]
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = at + 2 < offsets[doc + 1]
    found[which[inside], doc[inside]] = True
    return found


def answer(query: Query, found: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The documents of a segment that a query leaves."""
    if query is True:
        return np.ones(found.shape[1], bool)
    if isinstance(query, bytes):
        return found[np.searchsorted(codes, int.from_bytes(query, "big"))]
    a, b = (answer(q, found, codes) for q in query[1])
    return a & b if query[0] == "and" else a | b


def _span_text(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{i}:{j}" for i, k, j in sorted(spans))


def scan_secrets(docs: DataFrame, more_rules: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for each row of ``docs(doc_id, text, ...)``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then
    by the order of the rules, joined by commas; of the assignments they cover the
    whole match. ``base_sha256`` digests those of the three base kinds. A null or
    empty text has none. Kinds may overlap one another. Every row is scanned by
    itself and whole; repeated rows come as often as they are given.
    """
    rules = BASE_RULES + tuple(more_rules)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = compiled(rules)
        rows = []
        for part in short_batches(batch, 1):
            column = part.column(1).cast(pa.large_string()).fill_null("")
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = column.buffers()[2]
            raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
            found = postings(raw, ends - ends[0], made)
            texts = column.to_pylist()
            spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, (rule, pattern, query) in enumerate(zip(rules, made.patterns, made.queries, strict=True)):
                for d in np.flatnonzero(answer(query, found, made.codes)).tolist():
                    spans[d] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[d]) if len(m[rule.group]) >= rule.least]
            for d, own in enumerate(spans):
                base = [s for s in own if s[1] < len(BASE_RULES)]
                counts = [sum(s[1] == k for s in base) for k in range(len(BASE_RULES))]
                digest = hashlib.sha256(_span_text(base, rules).encode()).hexdigest()
                rows.append((part.column(0)[d].as_py(), *counts, digest, _span_text(own, rules)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, per_batch)
