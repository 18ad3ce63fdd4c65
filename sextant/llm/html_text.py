"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat run of text blocks. A block's features are its word count and
link density and those of the block before and the one after. A decision tree, grown
on a small table of labelled blocks made by rule, tells the article's blocks from link
lists, site names, notes and the like. Prose that is no part of the article can't be
told by words and links: elements that HTML has for other things, and elements whose
class, id or role says in whole that they are a comment, an advert or such, are never
given to the tree; they are only neighbours. A page's ``main`` is its main part wherever
it is, and so is an article inside a form or behind a menu that is left open.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# What HTML says of its elements.
RAW = "script style noscript template iframe svg math textarea select title".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
FURNITURE = frozenset("nav header footer aside form button dialog menu fieldset".split())
STORY = frozenset("article main".split())
#: Elements that don't end the head.
IN_HEAD = frozenset("head html base basefont bgsound link meta title style script noscript template".split())

#: Elements around an article that don't make it a side matter: page-wide forms, and a menu or header left open.
WRAPPING = frozenset("form fieldset nav header".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[\"'>]")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


class Token(NamedTuple):
    """A piece of markup: where it is, its lower-case name ('' for a comment or declaration), and what kind."""

    start: int
    end: int
    name: str
    closing: bool = False
    raw: bool = False
    rest: str = ""


def tokens(page: str) -> Iterator[Token]:
    """The markup of a page in order, in one pass that never goes back over what it has read.

    A tag ends at the first ``>`` outside quotes. If a quote is never closed, it and all
    tags after it end at their first ``>``. An element whose content isn't markup
    (``script`` and such) is one token up to its end, or the page's.
    """
    last, at, quoted = page.rfind(">"), 0, True

    def tag_end(i: int) -> int:
        nonlocal quoted
        j = i
        while quoted:
            found = _STOP.search(page, j)
            if not found:
                break
            if found[0] == ">":
                return found.end()
            j = page.find(found[0], found.end()) + 1
            if not j:
                break
        quoted = False
        return page.find(">", i) + 1

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = len(page) if end < 3 else end
            yield Token(at, end, "")
        elif at > last:
            return
        elif found := _NAME.match(page, at + 1):
            name, closing = found[2].lower(), bool(found[1])
            end = tag_end(found.end())
            rest = page[found.end() : end - 1]
            raw = not closing and name in _RAW_END
            if raw and not (name in ("svg", "math") and rest.endswith("/")):
                close = _RAW_END[name].search(page, end)
                end = close.end() if close else len(page)
            yield Token(at, end, name, closing, raw, rest)
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield Token(at, end, "")
        else:
            end = at + 1
        at = end


_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
# Words that name what is not the article, and words that say nothing beside them.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar"
    " navigation newsletter notice pagination popup promo promotion related replies reply share sharing sidebar signup skip social sponsor sponsored"
    " subscribe toolbar widget contentinfo complementary".split()
)
STORY_NAMES = frozenset("main content article story main-content article-body entry-content post-content".split())
NEUTRAL_NAMES = frozenset("area bar block box container form item items link links list main page posts section site top user widgets wrap wrapper".split())


def names_an_aside(names: str) -> bool:
    """Whether one of the blank-separated names is made of such words only, as ``cookie-notice`` but not ``header-image``.

    An element that is also called ``main``, ``content``, ``article`` or such is none.
    """
    called = names.lower().split()
    if not STORY_NAMES.isdisjoint(called):
        return False
    for name in called:
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if any(p in ASIDE_NAMES for p in parts) and all(p in ASIDE_NAMES or p in NEUTRAL_NAMES for p in parts):
            return True
    return False


@dataclass
class Block:
    text: str
    words: int
    linked: int
    aside: bool


@dataclass
class _Open:
    name: str
    story: bool = False
    element: str = ""
    named: bool = False


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    open: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    anchors: int = 0
    names: Counter[str] = field(default_factory=Counter)

    def push(self, one: _Open) -> None:
        self.open.append(one)
        self.names[one.name] += 1

    def close(self, name: str) -> None:
        """Close the innermost element of the name and all inside it; nothing if none is open."""
        while self.names[name]:
            last = self.open.pop()
            self.names[last.name] -= 1
            if last.name == name:
                return

    def text(self, raw: str) -> None:
        self.parts.append(raw)
        if self.anchors:
            self.linked.append(raw)

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                top = self.open[-1] if self.open else _Open("")
                words, linked = len(text.split()), len(html.unescape(" ".join(self.linked)).split())
                self.blocks.append(Block(text, words, min(words, linked), bool(top.element) or top.named))
        self.parts, self.linked = [], []


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; what cannot be shown as text is left out."""
    state, done, hidden = _Page(), 0, 0
    for token in tokens(page):
        if hidden and token.start > done and not page[done : token.start].isspace():
            hidden = 0  # text ends a head that isn't closed, as an element of the body does
        if token.start > done and not hidden:
            state.text(page[done : token.start])
        done = token.end
        name, closing = token.name, token.closing
        if token.raw or not name:
            if token.raw and name not in IN_HEAD:
                hidden = 0
            if token.raw and name not in ("script", "style"):
                state.text(" ")
            continue
        if name == "head":
            hidden = 0 if closing else 1
            continue
        if name in ("body", "html", "br") if closing else name not in IN_HEAD:
            hidden = 0
        if name == "a":
            state.anchors = max(0, state.anchors + (-1 if closing else 1))
        if name in INLINE:
            if name == "br":
                state.text(" ")
            continue
        state.end_block()
        state.anchors = 0
        if closing:
            state.close(name)
        elif name not in VOID and not token.rest.rstrip().endswith("/"):
            if name == "p" and state.open and state.open[-1].name == "p":
                state.close("p")
            above = state.open[-1] if state.open else _Open("")
            called = " ".join(n.strip("\"'") for n in _NAMED.findall(token.rest)) if "=" in token.rest else ""
            # A page's main part is that wherever it is; an article inside a form, or behind a menu left open, is one all the same.
            element = "" if name == "main" or name == "article" and above.element in WRAPPING else above.element
            if name in FURNITURE and not (name == "header" and above.story) and element in ("", *WRAPPING):
                element = name  # an article's own header is part of it
            named = bool(called) and name not in ("body", "html", "main") and names_an_aside(called) or above.named and name not in STORY
            state.push(_Open(name, above.story or name in STORY, element, named))
    if not hidden or page[done:].strip():
        state.text(page[done:])
    state.end_block()
    return state.blocks


def features_of(blocks: list[Block]) -> np.ndarray:
    """Words and link density of each block, the one before and the one after."""
    words = np.array([0, *(b.words for b in blocks), 0], float)
    density = np.array([0, *(b.linked / b.words for b in blocks), 0], float)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:]])


@dataclass(frozen=True)
class Tree:
    """A binary decision tree in arrays; a leaf has feature -1."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            low = x[rows, self.feature[node]] <= self.limit[node]
            at[rows] = np.where(low, self.left[node], self.right[node])
        return self.share[at] >= 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 5) -> Tree:
    """A tree of Gini splits; ties take the first feature and the lowest limit."""
    rows: list[list[float]] = []

    def node(members: np.ndarray, level: int) -> int:
        me = len(rows)
        rows.append([-1, 0, 0, 0, float(y[members].mean())])
        if level == depth or len(members) < 2 * least or y[members].min() == y[members].max():
            return me
        best = (np.inf, -1, 0.0)
        n = len(members)
        for f in range(x.shape[1]):
            order = members[np.argsort(x[members, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= least) & (cut <= n - least)]
            if cut.size:
                a, b = ones[cut - 1], ones[-1] - ones[cut - 1]
                gini = a * (1 - a / cut) + b * (1 - b / (n - cut))
                k = int(gini.argmin())
                if gini[k] < best[0] - 1e-9:
                    best = (float(gini[k]), f, float((v[cut[k] - 1] + v[cut[k]]) / 2))
        share = y[members].mean()
        if best[1] < 0 or best[0] >= n * share * (1 - share) - 1e-9:
            return me
        low = x[members, best[1]] <= best[2]
        rows[me][:2] = best[1:]
        rows[me][2] = node(members[low], level + 1)
        rows[me][3] = node(members[~low], level + 1)
        return me

    node(np.arange(len(y)), 0)
    f, limit, left, right, share = np.array(rows).T
    return Tree(f.astype(int), limit, left.astype(int), right.astype(int), share)


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Made-up pages and their blocks in order, each with whether it is of the article.

    No element or name tells a block's kind; class names are any words.
    """
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("aeiou") + rnd.choice("bcdfglmnprst") for _ in range(rnd.randint(1, 4))) for _ in range(400)]

    def words(low: int, high: int) -> str:
        return " ".join(rnd.choices(vocabulary, k=rnd.randint(low, high)))

    def prose(low: int, high: int) -> str:
        return " ".join(words(4, 22).capitalize() + "." for _ in range(rnd.randint(low, high)))

    out = []
    for _ in range(count):
        said: list[tuple[str, bool]] = []

        def put(text: str, good: bool, linked: float = 0.0) -> str:
            """A block; ``linked`` is the share of its words that a link holds."""
            said.append((text, good))
            parts = text.split(" ")
            n = round(linked * len(parts))
            shown = f'<a href="/{len(said)}">{" ".join(parts[:n])}</a> {" ".join(parts[n:])}' if n else text
            tag = rnd.choice(["p", "div", "li", "h2"])
            return f'<{tag} class="{rnd.choice(vocabulary)}">{shown}</{tag}>'

        def links(low: int, high: int) -> str:
            return "".join(put(words(1, 4), False, 1.0) for _ in range(rnd.randint(low, high)))

        page = []
        if rnd.random() < 0.5:
            page.append(put(words(1, 5), False, 1.0))  # a site's name
        if rnd.random() < 0.9:
            page.append(links(3, 9))
        if rnd.random() < 0.5:
            page.append(put(words(3, 16), False, rnd.choice([0.3, 0.6])))  # a note with a link
        page.append(put(words(2, 14), True))
        for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            kind = rnd.random()
            page.append(put(prose(1, 7) if kind < 0.7 else words(1, 6), True, rnd.choice([0.0] * 8 + [0.05, 0.15])))
            if rnd.random() < 0.1:  # between two paragraphs a sentence that is mostly a link
                page += [put(prose(2, 5), True), put(words(8, 24), True, rnd.choice([0.3, 0.45, 0.6, 0.75])), put(prose(2, 5), True)]
            if rnd.random() < 0.05:
                page.append(put(words(1, 6), False, 1.0))  # a link to more
        if rnd.random() < 0.6:
            page.append(put(words(1, 3), False, 1.0))
            page.append(links(2, 6))
        if rnd.random() < 0.3:
            page.append(put(prose(1, 1), False, 0.8))
        if rnd.random() < 0.5:
            page.append(put(words(2, 12), False, rnd.choice([0.3, 0.7, 1.0])))  # whose page it is
        out.append(("<html><body>" + "".join(page) + "</body></html>", said))
    return out


def labelled_blocks(pages: list[tuple[str, list[tuple[str, bool]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks."""
    xs, ys = [], []
    for page, said in pages:
        blocks = blocks_of(page)
        assert [b.text for b in blocks] == [t for t, _ in said]
        xs.append(features_of(blocks))
        ys.append(np.array([good for _, good in said], float))
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=2)
def trained(pages: int = 400, seed: int = 11) -> Tree:
    """The tree of ``pages`` labelled pages."""
    return grow(*labelled_blocks(labelled_pages(pages, seed)))


def main_text(page: str | None, tree: Tree) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    return "\n".join(b.text for b, good in zip(blocks, tree.predict(features_of(blocks)), strict=True) if good and not b.aside)


def extract_main_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages(page_id, url, html, ...)``.

    Character references are decoded and white space inside a block is one space;
    a line break element counts as white space. Blocks are joined by one newline.
    Null, empty and markup-only pages have an empty text. Every row is read by
    itself and whole; repeated rows come as often as they are given.
    """
    tree = tree or trained()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p.as_py(), tree) for p in batch.column(2)]
        made = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        return pa.RecordBatch.from_arrays(made, names=["page_id", "url", "text", "n_chars"])

    frame = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_rows(frame, "page_id long, url string, text string, n_chars long", per_batch, text=2)
