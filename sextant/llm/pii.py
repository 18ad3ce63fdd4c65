"""Personal data by base expressions and a skip-chain conditional random field.

The base expressions find well-formed e-mail and IP addresses, card and phone
numbers. Other mentions (digits in groups, disguised addresses, user names that an
address in the document gives away) are nodes of a conditional random field along
with the base finds, whose labels are fixed. Neighbours in the text share a chain
potential. Mentions of the same number or name anywhere in the document share a
skip potential with the one before and with the first base find, so a number that is plainly a phone number once labels its
disguised repeats. Loopy belief propagation gives each node's label; the weights
are trained by pseudo-likelihood on a small labelled table made by rule.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, short_batches

# The kinds and expressions of the contract.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Mentions that the base expressions may have missed.
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[ ().\[\]/-]{0,3}[0-9])+(?![0-9A-Za-z])")
_DISGUISED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}(?:@| ?[\[(](?:at|AT)[\])] ?)[A-Za-z0-9-]{2,64}(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]{1,64})*"
)
_DEFANGED = re.compile(r"(?<![0-9A-Za-z.\]])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9A-Za-z]|\[?\.\]?[0-9])")
_CUES = (
    re.compile(r"e-?mail|contact|write to", re.I),
    re.compile(r"\bip\b|host|server|address", re.I),
    re.compile(r"card|visa|credit|payment", re.I),
    re.compile(r"phone|\btel\b|call|mobile|fax|whatsapp", re.I),
)
LABELS = 1 + len(KINDS)
#: How sure a label has to be for a span to be added.
SURE = 0.8
SWEEPS = 12


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """Leftmost matches: a local part is all of its run of characters before the sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind and start; a match that fails its check is dropped."""
    found = [(0, i, j) for i, j in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


@dataclass
class Mentions:
    """The nodes of a document: spans in text order, what is known and what they look like."""

    spans: list[tuple[int, int]]
    fixed: np.ndarray
    features: np.ndarray
    edges: np.ndarray


FEATURES = 16


def _features(text: str, start: int, end: int) -> np.ndarray:
    shown, f = text[start:end], np.zeros(FEATURES)
    digits = _digits(shown)
    parts = re.split(r"\[?\.\]?", shown)
    before = text[max(0, start - 28) : start]
    f[0] = 1
    f[1] = any(c in shown for c in "@[(") and any(c.isalpha() for c in shown)
    f[2] = bool(digits) and not f[1]
    f[3] = f[2] and 8 <= len(digits) <= 15
    f[4] = f[2] and 16 <= len(digits) <= 19
    f[5] = f[4] and luhn(digits)
    f[6] = shown[:1] == "+"
    f[7] = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts)
    f[8] = f[2] and len(digits) < 8
    f[9] = len(re.findall(r"[0-9][^0-9]+(?=[0-9])", shown)) >= 2
    f[10] = "(" in shown and f[2]
    f[11] = not f[1] and not f[2]
    for k, cue in enumerate(_CUES):
        f[12 + k] = bool(cue.search(before))
    return f


def _key(text: str, start: int, end: int) -> str:
    """What repeats of a mention have in common: the last nine digits, or the local part."""
    shown = text[start:end]
    head = re.split(r"@| ?[\[(](?:at|AT)[\])]", shown)[0].lower()
    if any(c.isalpha() for c in head):
        return head
    return _digits(shown)[-9:]


def mentions(text: str, base: list[tuple[int, int, int]]) -> Mentions | None:
    """The nodes of a document and the edges between them; None without a mention beyond ``base``."""
    taken = sorted((i, j) for _, i, j in base)
    starts = [i for i, _ in taken]

    def free(i: int, j: int) -> bool:
        k = bisect_left(starts, j)
        return not any(b > i for _, b in taken[max(0, k - 4) : k])

    extra: list[tuple[int, int]] = []
    if "@" in text or "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        extra += [m.span() for m in _DISGUISED.finditer(text) if free(*m.span())]
    rest = text
    if "[.]" in text:  # addresses with bracketed dots, whatever their number of digits
        parts, done = [], 0
        for m in _DEFANGED.finditer(text):
            if "[.]" in m[0] and all(int(p) <= 255 for p in re.split("[^0-9]+", m[0])) and free(*m.span()):
                extra.append(m.span())
                parts += [text[done : m.start()], " ; ".ljust(m.end() - m.start(), ";")]
                done = m.end()
        rest = "".join([*parts, text[done:]])
    for m in _NUMBER.finditer(rest):
        if m.end() - m.start() >= 7 and len(_digits(m[0])) >= 7 and free(*m.span()):
            extra.append(m.span())
    names = {_key(text, i, j) for k, i, j in base if k == 0}
    names = {n for n in names if len(n) >= 6 and re.search("[0-9._]", n)}
    if names:
        for m in re.finditer(r"[A-Za-z0-9._%+-]{6,64}", text):
            if m[0].rstrip(".").lower() in names and free(*m.span()) and text[m.end() : m.end() + 1] != "@":
                extra.append((m.start(), m.start() + len(m[0].rstrip("."))))
    if not extra:
        return None
    nodes = sorted({*((i, j, k + 1) for k, i, j in base), *((i, j, 0) for i, j in extra)})
    spans = [(i, j) for i, j, _ in nodes]
    edges, last, sure = [(a, a + 1, 0) for a in range(len(nodes) - 1)], {}, {}
    keys = [_key(text, i, j) for i, j in spans]
    for n, key in enumerate(keys):
        if nodes[n][2]:
            sure.setdefault(key, n)
    for n, key in enumerate(keys):
        linked = {last.get(key), sure.get(key)} - {None, n}
        edges += [(*sorted((m, n)), 1) for m in sorted(linked)]
        last[key] = n
    return Mentions(
        spans,
        np.array([k for *_, k in nodes]),
        np.stack([_features(text, i, j) for i, j in spans]),
        np.array(edges, np.int64).reshape(-1, 3),
    )


@dataclass(frozen=True)
class Model:
    node: np.ndarray  # labels x features
    edge: np.ndarray  # chain and skip, labels x labels

    def beliefs(self, doc: Mentions, skips: bool = True) -> np.ndarray:
        """Label marginals by loopy sum-product; base finds are fixed."""
        unary = doc.features @ self.node.T
        known = doc.fixed > 0
        unary[known] = -30.0
        unary[known, doc.fixed[known]] = 0.0
        edges = doc.edges if skips else doc.edges[doc.edges[:, 2] == 0]
        a, b, kind = edges.T
        table = self.edge[kind]
        to_b, to_a = np.zeros((len(edges), LABELS)), np.zeros((len(edges), LABELS))
        for _ in range(SWEEPS):
            total = unary.copy()
            np.add.at(total, b, to_b)
            np.add.at(total, a, to_a)
            out_b = _normal(_lse((total[a] - to_a)[:, :, None] + table, 1))
            out_a = _normal(_lse((total[b] - to_b)[:, None, :] + table, 2))
            change = max(np.abs(out_b - to_b).max(initial=0), np.abs(out_a - to_a).max(initial=0))
            to_b, to_a = 0.5 * (to_b + out_b), 0.5 * (to_a + out_a)
            if change < 1e-4:
                break
        total = unary.copy()
        np.add.at(total, b, to_b)
        np.add.at(total, a, to_a)
        return np.exp(_normal(total))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _normal(x: np.ndarray) -> np.ndarray:
    return x - _lse(x, -1)[:, None]


def labelled_texts(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up texts with the spans and labels of all their mentions, by rule from ``seed``."""
    rnd = random.Random(seed)
    words = "the of and with for report order total from page item note see list when that value".split()
    cue = {1: "email", 2: "server ip", 3: "card", 4: "phone"}

    def number(n: int) -> str:
        return str(rnd.randint(1, 9)) + "".join(str(rnd.randint(0, 9)) for _ in range(n - 1))

    def person(label: int) -> list[str]:
        if label == 1:
            name = f"{rnd.choice('abcdefgh')}{rnd.choice(['lee', 'kim', 'roy', 'diaz'])}.{rnd.randint(10, 9999)}"
            host = rnd.choice(["example.com", "mail.example.org"])
            return [f"{name}@{host}", f"{name} [at] {host}", f"{name}@{host.split('.')[0]}", name]
        if label == 2:
            p = [str(rnd.randint(1, 255)) for _ in range(4)]
            return [".".join(p), "[.]".join(p)]
        if label == 3:
            d = number(15)
            d = next(d + str(c) for c in range(10) if luhn(d + str(c)))
            g = [d[i : i + 4] for i in range(0, 16, 4)]
            return [d, "-".join(g), ".".join(g), "/".join(g)]
        d = number(10)
        return [f"+1 {d[:3]}-{d[3:6]}-{d[6:]}", f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", d, "1" + d]

    def plain() -> list[str]:
        kind = rnd.randrange(4)
        if kind == 0:
            return [number(rnd.randint(7, 16))]
        if kind == 1:
            return [f"{rnd.randint(1900, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}"]
        if kind == 2:
            return [f"{rnd.randint(1, 9)}.{rnd.randint(0, 99)}.{rnd.randint(0, 9)}.{rnd.randint(1000, 9999)}"]
        return [" ".join(number(3) for _ in range(rnd.randint(3, 4)))]

    out = []
    for _ in range(count):
        things = [(k, person(k)) for k in rnd.choices((1, 2, 3, 4), k=rnd.randint(0, 3))] + [(0, plain()) for _ in range(rnd.randint(0, 4))]
        said = [(k, rnd.choice(forms)) for k, forms in things for _ in range(rnd.randint(1, 4))]
        rnd.shuffle(said)
        text, spans = "", []
        for k, form in said:
            text += " ".join(rnd.choices(words, k=rnd.randint(2, 9))) + " "
            if k and rnd.random() < 0.35:
                text += cue[k] + rnd.choice([" ", ": "])
            spans.append((len(text), len(text) + len(form), k))
            text += form + rnd.choice([" ", ", ", "; "])
        out.append((text, spans))
    return out


def gold(doc: Mentions, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of each node: that of the labelled span it lies in for the most part."""
    label = doc.fixed.copy()
    for n, (i, j) in enumerate(doc.spans):
        if not label[n]:
            label[n] = next((k for a, b, k in spans if min(b, j) - max(a, i) > 0.5 * (j - i)), 0)
    return label


@lru_cache(maxsize=2)
def trained(texts: int = 600, seed: int = 7, steps: int = 250) -> Model:
    """Weights by gradient ascent on the pseudo-likelihood of ``texts`` labelled texts."""
    docs = [(m, gold(m, spans)) for text, spans in labelled_texts(texts, seed) if (m := mentions(text, base_spans(text)))]
    at = np.cumsum([0, *(len(m.spans) for m, _ in docs)])
    x = np.concatenate([m.features for m, _ in docs])
    y = np.concatenate([g for _, g in docs])
    free = np.concatenate([m.fixed == 0 for m, _ in docs])
    edges = np.concatenate([m.edges + [o, o, 0] for (m, _), o in zip(docs, at, strict=False)])
    a, b, kind = edges.T
    target = np.eye(LABELS)[y]
    node, edge = np.zeros((LABELS, x.shape[1])), np.zeros((2, LABELS, LABELS))
    for step in range(steps):
        score = x @ node.T
        np.add.at(score, b, edge[kind, y[a]])
        np.add.at(score, a, edge[kind, :, y[b]])
        miss = (target - np.exp(_normal(score))) * free[:, None]
        rate = 4.0 / (1 + step / 50) / free.sum()
        node += rate * (miss.T @ x - 0.05 * node)
        grad = np.zeros_like(edge)
        np.add.at(grad, (kind, y[a]), miss[b])
        np.add.at(grad.transpose(0, 2, 1), (kind, y[b]), miss[a])
        edge += rate * (grad - 0.05 * edge)
    return Model(node, edge)


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the mentions that the model is sure of."""
    doc = mentions(text, base)
    if doc is None:
        return []
    belief = model.beliefs(doc)
    best = belief.argmax(axis=1)
    return [
        (int(best[n]) - 1, i, j)
        for n, (i, j) in enumerate(doc.spans)
        if not doc.fixed[n] and best[n] and belief[n, best[n]] >= SURE
    ]


def _span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for k, i, j in sorted(set(spans)))


_TELLING = np.zeros(256, np.uint8)
_TELLING[list(b"0123456789@")] = 1


def _telling(raw: np.ndarray) -> np.ndarray:
    """Which bytes show that a text may hold a mention: digits, ``@``, and the end of a bracketed ``at``."""
    out = _TELLING[raw]
    a, t, end = raw[:-2], raw[1:-1], raw[2:]
    out[2:] |= ((end == ord("]")) | (end == ord(")"))) & ((a == ord("a")) & (t == ord("t")) | (a == ord("A")) & (t == ord("T")))
    return out


def scan_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for each row of ``docs(doc_id, text, ...)``.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind and then
    start, joined by commas. ``n_*`` and ``base_sha256`` speak of the base finds,
    all of which are in ``spans`` with those the field adds. A null or empty text
    has none. Every row is read by itself and whole; repeated rows come as often as
    they are given, other columns are ignored.
    """
    model = model or trained()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
        for part in short_batches(batch, 1):
            column = part.column(1).cast(pa.large_string()).fill_null("")
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = column.buffers()[2]
            raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
            sums = np.r_[0, np.cumsum(_telling(raw), dtype=np.int64)]
            telling = np.diff(sums[ends - ends[0]]) > 0
            for doc, text, told in zip(part.column(0).to_pylist(), column, telling, strict=True):
                text = text.as_py() if told else ""
                if not told and not text:
                    rows.append((doc, *nothing))
                    continue
                base = base_spans(text)
                counts = [sum(k == s[0] for s in base) for k in range(len(KINDS))]
                every = base + added_spans(text, base, model)
                rows.append((doc, *counts, hashlib.sha256(_span_text(base).encode()).hexdigest(), _span_text(every)))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, per_batch)
