"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of words. The CGK random walk writes a sequence out symbol by
symbol, staying on or moving past each by a random bit of the symbol and the step,
which turns a small edit distance into a small Hamming distance. A table of the LSH
samples a few output positions; a window that agrees with a benchmark item on all
of a table's samples is a candidate, and its words are compared with the item's by
edit distance. Walks start at every word of every document, so each window has the
size of the item it is compared with. Long items are cut into blocks, one of which
has no more than its share of the edits; a block's hit is verified over the whole
item. Items that allow no edit walk straight on and sample every step, which finds
them all. For the others the number of tables comes from the wanted recall, measured
on edited copies of the blocks with other words behind them; a class that doesn't
reach it is compared in full.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, short_batches

#: Share of an item's words that may be edited.
EDITS = 0.2
RECALL = 0.98
SAMPLES = 4
#: Items and bytes compared in one pass over the documents; more take more passes.
ITEMS_PER_PASS = 20_000
BYTES_PER_PASS = 64 << 20
#: Most words of a block; the walks of longer ones drift apart under edits.
BLOCK_WORDS = 40
#: A class whose recall isn't reached by so many tables is compared without tables.
MOST_TABLES = 256
#: Edited copies on which a class' tables are chosen, and as many on which they are checked.
COPIES = 500
#: Bytes of text that are compared together.
SLICE = 8 << 20

#: Scripts written without spaces; each of their characters is a word.
_ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_ALONE}]|[^\W_{_ALONE}]+")
#: Signs that end or begin many words, and words that take nothing but lower-casing.
_SIGNS = ".,;:!?\"'()[]{}<>*#$%&|/-_…“”„«»–—"
_PLAIN = "^[A-Za-z0-9À-ÖØ-öø-įĲ-ɏ]+$"
#: Walk states or edit rows that are worked on together.
_TOGETHER = 1 << 17


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; characters of scripts without spaces one by one."""
    return _WORD.findall((text or "").lower())


@dataclass(frozen=True)
class Walks:
    """The LSH tables of a class: the bits of each table's walk and the steps it samples.

    The bit of a symbol at a step is the top bit of the symbol's code times one
    random number plus another, so a table's size doesn't follow the vocabulary's.
    """

    times: np.ndarray  # tables x steps
    plus: np.ndarray
    sampled: tuple[np.ndarray, ...]  # for each step the tables that sample it
    seeds: np.ndarray

    def keys(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The key of the walk from each start in each table, a hash of the codes at the sampled steps.

        ``codes`` has to end with enough zeros for every walk to stay inside.
        """
        at = np.repeat(starts[None].astype(np.int64), len(self.seeds), axis=0)
        key = np.repeat(self.seeds[:, None], len(starts), axis=1)
        for step, rows in enumerate(self.sampled):
            code = codes.take(at, mode="clip")
            if rows.size:
                mixed = (key[rows] ^ code[rows]) * np.uint64(0x9E3779B97F4A7C15)
                key[rows] = mixed ^ (mixed >> np.uint64(31))
            code *= self.times[:, step, None]
            code += self.plus[:, step, None]
            code >>= np.uint32(31)
            np.add(at, code, out=at, casting="unsafe")
        return key


def random_walks(tables: int, steps: int, samples: int, rnd: np.random.Generator) -> Walks:
    times, plus = (rnd.integers(0, 2**32, (tables, steps), np.uint32) for _ in range(2))
    taken = np.stack([np.isin(np.arange(steps), rnd.choice(steps, min(samples, steps), replace=False)) for _ in range(tables)])
    return Walks(times, plus, tuple(np.flatnonzero(c) for c in taken.T), rnd.integers(0, 2**64, tables, np.uint64))


def straight_walk(steps: int) -> Walks:
    """One table that moves past every symbol and samples them all."""
    ones = np.full((1, steps), 1 << 31, np.uint32)
    return Walks(np.zeros_like(ones), ones, (np.zeros(1, np.int64),) * steps, np.zeros(1, np.uint64))


def joined(walks: list[Walks]) -> Walks:
    first = np.cumsum([0, *(len(w.seeds) for w in walks)])
    sampled = tuple(np.concatenate([r + n for r, n in zip(rows, first, strict=False)]) for rows in zip(*(w.sampled for w in walks), strict=True))
    return Walks(*(np.concatenate([getattr(w, f) for w in walks]) for f in ("times", "plus")), sampled, np.concatenate([w.seeds for w in walks]))


@dataclass(frozen=True)
class Block:
    """A run of an item's words, and the edits that one block of the item stays within."""

    item: int
    offset: int
    words: np.ndarray
    allowed: int


@dataclass(frozen=True)
class Class:
    """Blocks of about one length: all have ``least`` words or more and ``least * 1.25`` at most.

    ``used`` tells the symbols of these blocks. A window within reach of one has at
    least ``needed`` of them in its first ``least`` words, else no walk starts there.
    Without ``walks`` all ``members`` are compared there. ``keys`` are those of the
    blocks ``owners`` in all tables, in order.
    """

    least: int
    needed: int
    used: np.ndarray
    members: np.ndarray
    walks: Walks | None
    keys: np.ndarray
    owners: np.ndarray

    def candidates(self, codes: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and the blocks to compare there."""
        if self.walks is None:
            step = max(1, _TOGETHER // len(self.members))
            for i in range(0, len(near), step):
                yield np.repeat(near[i : i + step], len(self.members)), np.tile(self.members, len(near[i : i + step]))
            return
        step = max(1, _TOGETHER // len(self.walks.seeds))
        for i in range(0, len(near), step):
            keys = self.walks.keys(codes, near[i : i + step])
            first = np.searchsorted(self.keys, keys, "left")
            table, at = np.nonzero(self.keys.take(first, mode="clip") == keys)
            first = first[table, at]
            many = np.searchsorted(self.keys, keys[table, at], "right") - first
            owner = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            yield np.repeat(near[i + at], many), self.owners[owner]


@dataclass(frozen=True)
class Index:
    symbols: dict[str, int]
    codes: np.ndarray
    words: dict[int, np.ndarray]
    allowed: dict[int, int]
    blocks: tuple[Block, ...]
    classes: tuple[Class, ...]


def _padded(words: list[np.ndarray], room: int) -> tuple[np.ndarray, np.ndarray]:
    """All sequences behind one another, each followed by ``room`` zeros, and where each starts."""
    gap = np.zeros(room, np.int64)
    starts = np.cumsum([0, *(len(w) + room for w in words)])[:-1]
    return np.concatenate([x for w in words for x in (w, gap)]) if words else gap, starts


def _edited(word: np.ndarray, edits: int, symbols: int, rnd: np.random.Generator) -> np.ndarray:
    out = word.tolist()
    for _ in range(edits):
        at, kind = int(rnd.integers(len(out) + 1)), rnd.integers(3)
        new = int(rnd.integers(symbols))
        if kind == 0 or at == len(out):
            out.insert(at, new)
        elif kind == 1:
            out[at] = new
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.int64)


def _blocks(item: int, words: np.ndarray, allowed: int) -> list[Block]:
    """The item in equal blocks; ``allowed`` edits leave one with its share of them at most."""
    count = -(-len(words) // BLOCK_WORDS)
    cuts = [k * len(words) // count for k in range(count + 1)]
    return [Block(item, a, words[a:b], allowed // count) for a, b in zip(cuts, cuts[1:], strict=False)]


def build_index(items: list[tuple[int, str]], edits: float = EDITS, recall: float = RECALL, seed: int = 5) -> Index:
    """Symbols, lengths and LSH tables of the benchmark items."""
    rnd = np.random.default_rng(seed)
    split = {i: w for i, t in items if (w := words_of(t))}
    symbols: dict[str, int] = {}
    for w in split.values():
        for x in w:
            symbols.setdefault(x, len(symbols) + 1)
    words = {i: np.array([symbols[x] for x in w], np.int64) for i, w in split.items()}
    allowed = {i: int(edits * len(w)) for i, w in words.items()}
    codes = np.concatenate([np.zeros(1, np.uint32), rnd.integers(1, 2**32, len(symbols), np.uint32)])
    blocks = [b for i, w in words.items() for b in _blocks(i, w, allowed[i])]
    by_class: dict[tuple, list[int]] = defaultdict(list)
    for n, b in enumerate(blocks):
        size = len(b.words)
        by_class[(size,) if not b.allowed else (0, math.floor(math.log(size, 1.25) + 1e-9))].append(n)
    classes = []
    for members in by_class.values():
        least = min(len(blocks[n].words) for n in members)
        most = max(blocks[n].allowed for n in members)
        steps = least + least // 2 if most else least
        # Behind a block come the item's own words where it has more.
        flat, at = _padded([words[blocks[n].item][blocks[n].offset :][:steps] for n in members], steps)
        if most:
            walks = _enough_walks([blocks[n] for n in members], codes, flat, at, steps, recall, rnd)
        else:
            walks = straight_walk(steps)
        used = np.zeros(len(symbols) + 1, bool)
        used[np.concatenate([blocks[n].words for n in members])] = True
        keys = walks.keys(codes[flat], at).ravel() if walks else np.empty(0, np.uint64)
        owners = np.tile(members, len(keys) // len(members))
        order = np.argsort(keys, kind="stable")
        classes.append(Class(least, max(1, least - most), used, np.array(members), walks, keys[order], owners[order] if walks else owners))
    return Index(symbols, codes, words, allowed, tuple(blocks), tuple(classes))


def _enough_walks(blocks: list[Block], codes: np.ndarray, flat: np.ndarray, at: np.ndarray, steps: int, recall: float, rnd: np.random.Generator) -> Walks | None:
    """Tables until a set of edited copies and a second one they weren't chosen on both reach the recall; else none."""
    chosen = rnd.integers(0, len(blocks), 2 * COPIES)
    copies = [
        np.concatenate([_edited(blocks[n].words, blocks[n].allowed, len(codes), rnd), rnd.integers(0, len(codes), steps)])
        for n in chosen
    ]
    edited, edited_at = _padded(copies, steps)
    missed = np.ones(2 * COPIES, bool)
    walks: list[Walks] = []
    while len(walks) < MOST_TABLES:
        walks.append(random_walks(1, steps, SAMPLES, rnd))
        missed &= (walks[-1].keys(codes[flat], at[chosen]) != walks[-1].keys(codes[edited], edited_at))[0]
        if len(walks) > 1 and missed.reshape(2, -1).mean(axis=1).max() <= 1 - recall:
            return joined(walks)
    return None


def edit_distances(items: np.ndarray, lengths: np.ndarray, windows: np.ndarray, most: int) -> np.ndarray:
    """Least edits between each item and a prefix of its window, ``most + 1`` if more.

    Row ``k`` of ``items`` is an item of ``lengths[k]`` symbols. All rows go through one
    table of costs that is ``most`` wide on either side of the diagonal.
    """
    count, longest = items.shape
    width = np.arange(2 * most + 1, dtype=np.int16)
    text = np.full((count, longest + 2 * most), -1, windows.dtype)
    shown = windows[:, : longest + most]
    text[:, most : most + shown.shape[1]] = shown
    row = np.repeat(np.where(width >= most, width - most, most + 1).astype(np.int16)[None], count, axis=0)
    best = np.full(count, most + 1, np.int64)
    for i in range(longest):
        new = row + (text[:, i : i + len(width)] != items[:, i, None])
        np.minimum(new[:, :-1], row[:, 1:] + np.int16(1), out=new[:, :-1])
        new -= width
        np.minimum.accumulate(new, axis=1, out=new)
        new += width
        row = new
        ends = np.flatnonzero(lengths == i + 1)
        if ends.size:
            best[ends] = np.minimum(row[ends].min(axis=1), most + 1)
    return best


def best_window(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int]:
    """Least edits between ``item`` and any run of ``window``, ``most + 1`` if more, and where the run starts."""

    def last_row(item: np.ndarray, window: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(window) + 1)
        row = np.zeros_like(steps) if free else steps
        for i, symbol in enumerate(item.tolist(), 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (window != symbol))
            row = np.minimum.accumulate(np.concatenate([[i], best]) - steps) + steps
            if row.min() > most:
                break
        return row

    row = last_row(item, window, True)
    if row.min() > most:
        return most + 1, 0
    end = int(row.argmin())
    back = last_row(item[::-1], window[:end][::-1], False)
    return int(row.min()), end - int(np.flatnonzero(back == back.min())[-1])


class Reader:
    """Texts to symbols. Chunks between blanks are looked up once for all texts given together."""

    def __init__(self, symbols: dict[str, int]):
        self.symbols = symbols
        self.words = pa.array(list(symbols), pa.large_string())

    def read(self, texts: pa.Array) -> list[np.ndarray]:
        """The symbols of each text; words of no item are 0."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        chunks = split.flatten().dictionary_encode()
        core = pc.utf8_trim(chunks.dictionary, _SIGNS)
        plain = pc.match_substring_regex(core, _PLAIN).to_numpy(zero_copy_only=False)
        symbol = pc.fill_null(pc.index_in(pc.utf8_lower(core), value_set=self.words), -1).to_numpy(zero_copy_only=False) + 1
        odd = [[self.symbols.get(w, 0) for w in words_of(c)] for c in chunks.dictionary.filter(pa.array(~plain)).to_pylist()]
        many = np.ones(len(plain), np.int64)
        many[~plain] = [len(o) for o in odd]
        known = np.empty(many.sum(), np.int64)
        known[np.repeat(plain, many)] = symbol[plain]
        known[np.repeat(~plain, many)] = [s for o in odd for s in o]
        place = chunks.indices.to_numpy(zero_copy_only=False)
        many, first = many[place], (np.cumsum(many) - many)[place]
        ends = np.r_[0, np.cumsum(many)]
        flat = known[np.repeat(first - ends[:-1], many) + np.arange(ends[-1])]
        offsets = split.offsets.to_numpy(zero_copy_only=False)
        return np.split(flat, ends[offsets[1:-1] - offsets[0]]) if len(texts) else []


def hits(texts: list[np.ndarray], index: Index) -> list[tuple[int, int, int, int]]:
    """``(text, item, start, edits)`` of the best window of each item in each text that has one."""
    if not index.classes:
        return []
    room = 2 * max(c.least for c in index.classes) + 2
    flat, starts = _padded(texts, room)
    ends = starts + [len(t) for t in texts]
    codes = index.codes[flat]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    looked: dict[tuple[int, int], list[int]] = defaultdict(list)

    def compare(at: np.ndarray, block: np.ndarray) -> None:
        """Compare blocks with the windows that start ``at``, all of about one length."""
        mine = [index.blocks[n] for n in block.tolist()]
        lengths = np.array([len(b.words) for b in mine])
        part = np.array([len(b.words) < len(index.words[b.item]) for b in mine])
        longest = int(lengths.max())
        items = np.zeros((len(mine), longest), np.int64)
        items[np.arange(longest) < lengths[:, None]] = np.concatenate([b.words for b in mine])
        # A block of a longer item may have more than its share of the edits.
        most = np.where(part, lengths // 2, [index.allowed[b.item] for b in mine])
        widest = int(most.max())
        far = edit_distances(items, lengths, flat[at[:, None] + np.arange(longest + widest).clip(0, room - 1)], widest)
        text = np.searchsorted(starts, at, "right") - 1
        for k in np.flatnonzero(far <= most).tolist():
            key, here, found = (int(text[k]), mine[k].item), int(at[k]), int(far[k])
            if part[k]:
                here, found = whole(key, here - mine[k].offset)
            if found <= index.allowed[key[1]]:
                best[key] = min(best.get(key, (found, here)), (found, here))

    def whole(key: tuple[int, int], here: int) -> tuple[int, int]:
        """The best run for a long item near ``here``; what is read covers all starts as near to it as the edits allow."""
        text, item = key
        most, word = index.allowed[item], index.words[item]
        if any(abs(here - x) <= most for x in looked[key]):
            return here, most + 1
        looked[key].append(here)
        low = max(int(starts[text]), here - 2 * most)
        found, at = best_window(word, flat[low : max(low, min(here + len(word) + 3 * most, int(ends[text])))], most)
        return low + at, found

    for group in index.classes:
        sums = np.concatenate([[0], np.cumsum(group.used[flat], dtype=np.int32)])
        near = np.flatnonzero(sums[group.least :] - sums[: -group.least] >= group.needed)
        near = near[near < ends[np.searchsorted(starts, near, "right") - 1]]  # none in the zeros behind a text
        pairs = [at * len(index.blocks) + block for at, block in group.candidates(codes, near)]
        found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        step = max(1, _TOGETHER // (group.least + 1))
        for i in range(0, len(found), step):
            compare(*np.divmod(found[i : i + step], len(index.blocks)))
    return [(text, item, start - int(starts[text]), far) for (text, item), (far, start) in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """``(doc_id, item_id, n_edits, at_word)``: the benchmark items that documents contain.

    An item is in a document if a window of the document's words is within
    ``edits`` of the item's words in edit distance, compared in lower case without
    punctuation; the best window of each item is returned, found with probability
    ``recall`` at the largest distance and nearly surely at smaller ones, whatever
    the item's length. Items so short that they allow no edit are found exactly and
    always. Null and empty texts contain nothing; items that are null or without a
    letter or digit are in nothing. Repeated rows of ``docs`` are found each; items
    that are equal are all found, repeated rows of ``benchmark`` count once, and
    several texts of one item give a row each. Texts are read whole, windows overlap
    at every word.

    Items travel to the tasks in passes of about ``ITEMS_PER_PASS`` items and
    ``BYTES_PER_PASS`` bytes by their hash, so what is sent has a bound and a larger
    benchmark takes more passes.
    """
    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    wanted = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    size = wanted.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-size["items"] // ITEMS_PER_PASS), -(-size["bytes"] // BYTES_PER_PASS))
    found = None
    for n in range(passes):
        held = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n).collect()
        one = _one_pass(frame, sorted((r["item_id"], r["text"]) for r in held), edits, recall)
        found = one if found is None else found.unionByName(one)
    return found


def _one_pass(frame: DataFrame, items: list[tuple[int, str]], edits: float, recall: float) -> DataFrame:
    # An item may have several texts; each is an item of its own here.
    number = np.array([i for i, _ in items], np.int64)
    index = build_index([(n, t) for n, (_, t) in enumerate(items)], edits, recall)
    sent = frame.sparkSession.sparkContext.broadcast(index)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = sent.value
        reader = Reader(index.symbols)
        rows: list[tuple[int, int, int, int]] = []
        for part in short_batches(batch, 1, SLICE):
            docs = part.column(0).to_pylist()
            rows += [(docs[t], number[i], far, start) for t, i, start, far in hits(reader.read(part.column(1)), index)]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_edits", "at_word"])

    return map_rows(frame, "doc_id long, item_id long, n_edits long, at_word long", per_batch)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document holds no benchmark item; rows without a ``doc_id`` stay."""
    leaked = find_leaks(docs, benchmark).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(leaked, docs["doc_id"] == leaked["__leaked"], "left_anti")
