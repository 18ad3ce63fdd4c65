"""Edited copies of long benchmark items, with words of the vocabulary around them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sextant.llm import decontamination

from .test_corpus_operators import plain_leaks


@pytest.mark.parametrize("length", [16, 25, 40, 60, 120, 300, 500])
def test_edited_copies_of_long_items(length):
    rnd = random.Random(length)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(length))) for i in range(100)]
    texts = []
    for i, item in items:
        copy = item.split()
        for _ in range(int(0.2 * length)):
            at, kind = rnd.randrange(len(copy)), rnd.randrange(3)
            copy[at : at + (kind > 0)] = [rnd.choice(words)] * (kind < 2)
        around = [[rnd.choice(words) for _ in range(120)] for _ in range(2)]
        texts.append((i, " ".join([*around[0], *copy, *around[1]])))
    index = decontamination.build_index(items)
    read = decontamination.Reader(index.symbols).read(pa.array([t for _, t in texts]))
    found = {(t, i): (start, far) for t, i, start, far in decontamination.hits(read, index)}
    assert sum((i, i) in found for i, _ in items) >= 95
    for key in list(found)[:5]:
        assert found[key][1] == plain_leaks([texts[key[0]]], [items[key[1]]])[key]


def test_a_class_that_misses_its_recall_is_compared_in_full(monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_TABLES", 2)
    rnd = random.Random(1)
    items = [(i, " ".join(f"w{rnd.randrange(300)}" for _ in range(35))) for i in range(4)]
    texts = [" ".join(["x"] + ["new" if k % 5 == 2 else w for k, w in enumerate(t.split())]) for _, t in items]
    index = decontamination.build_index(items)
    assert not any(c.walks for c in index.classes)
    read = decontamination.Reader(index.symbols).read(pa.array(texts))
    got = sorted(decontamination.hits(read, index))
    assert got == [(i, i, 1, 7) for i in range(4)]


def test_best_window():
    window = np.array([9, 9, 1, 2, 8, 4, 5, 9])
    assert decontamination.best_window(np.array([1, 2, 3, 4, 5]), window, 2) == (1, 2)
    assert decontamination.best_window(np.array([6, 7, 6, 7]), window, 1) == (2, 0)


def test_reader_equals_plain_words():
    symbols = {w: n for n, w in enumerate(["one", "two", "été", "i̇", "漢", "x1"], 1)}
    texts = ["One, two! (ÉTÉ) one-two x1_two", None, "", " \t\n", "İ 漢字漢 ... --", "nothing here", "ΑΣ Σ é.t.é ½ \u00a0one\u2003two", "one"]
    got = decontamination.Reader(symbols).read(pa.array(texts))
    assert [g.tolist() for g in got] == [[symbols.get(w, 0) for w in decontamination.words_of(t)] for t in texts]
    sliced = decontamination.Reader(symbols).read(pa.array(texts).slice(3, 4))
    assert [g.tolist() for g in sliced] == [g.tolist() for g in got[3:7]]


def test_short_items_are_found_exactly():
    items = [(0, "alpha"), (1, "beta gamma"), (2, "alpha beta gamma delta"), (3, "漢字"), (4, "!!!"), (5, "Alpha beta")]
    texts = ["x ALPHA, y", "beta x gamma", "then beta gamma.", "so alpha beta gamma delta", "彼は漢字を読む", "", "字漢"]
    index = decontamination.build_index(items)
    got = {(t, i) for t, i, *_ in decontamination.hits(decontamination.Reader(index.symbols).read(pa.array(texts)), index)}
    want = {(0, 0), (2, 1), (3, 0), (3, 1), (3, 2), (3, 5), (4, 3)}
    assert got == want == {k for k in plain_leaks(list(enumerate(texts)), items)}
