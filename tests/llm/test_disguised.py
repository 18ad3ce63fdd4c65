"""Disguised mentions that no digit or sign of the base expressions gives away."""

import time
from itertools import product

import numpy as np
import pytest

from sextant.llm import pii, secret_scan


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    return [r["spans"] for r in sorted(pii.scan_personal_data(docs).collect())]


def test_address_without_a_digit(spark):
    text = "write to jane.doe [at] example [dot] com"
    want = pii.added_spans(text, [], pii.trained())
    assert want == [(0, 9, len(text))]
    got = spans(spark, [text, "at", "] plain", text.replace("[at]", "(AT)"), None])
    assert got == [f"email:9:{len(text)}", "", "", f"email:9:{len(text)}", ""]


def test_short_bracketed_address(spark):
    text = "server ip 10[.]0[.]0[.]1 and more"
    assert spans(spark, [text, "version 10[.]0[.]0[.]999"]) == ["ip:10:24", ""]
    found = pii.mentions("the 10[.]0[.]0[.]1 555-0000-1", [])
    assert found.spans == [(4, 18), (19, 29)]


def exact_marginals(doc, model):
    """By all labellings of the nodes."""
    n = len(doc.spans)
    unary = doc.features @ model.node.T
    total = np.zeros((n, pii.LABELS))
    for labels in product(range(pii.LABELS), repeat=n):
        if any(k and labels[i] != k for i, k in enumerate(doc.fixed)):
            continue
        score = sum(unary[i, k] for i, k in enumerate(labels) if not doc.fixed[i])
        score += sum(model.edge[kind, labels[a], labels[b]] for a, b, kind in doc.edges)
        for i, k in enumerate(labels):
            total[i, k] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("edges", [[(0, 1, 0), (1, 2, 0), (2, 3, 0)], [(0, 1, 0), (1, 2, 1), (1, 3, 1)], [(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1)]])
@pytest.mark.parametrize("fixed", [[0, 0, 0, 0], [4, 0, 0, 0]])
def test_messages_against_all_labellings(edges, fixed):
    """Exact on trees, close on a loop."""
    rnd = np.random.default_rng(2)
    model = pii.Model(rnd.normal(0, 1, (pii.LABELS, pii.FEATURES)), rnd.normal(0, 0.5, (2, pii.LABELS, pii.LABELS)))
    doc = pii.Mentions([(i, i + 1) for i in range(4)], np.array(fixed), rnd.normal(0, 0.5, (4, pii.FEATURES)), np.array(edges))
    tree = len(edges) == 3
    assert np.abs(model.beliefs(doc) - exact_marginals(doc, model)).max() < (0.01 if tree else 0.06)


def log_lines(size):
    """Log-like text: dates, addresses, names and numbers in every line."""
    line = "2024-01-{:02d} 12:{:02d}:01 host 10.0.{}.{} user=a{}@x{}.com call 555 {} {} done\n"
    return "".join(line.format(i % 28 + 1, i % 60, i % 256, i * 7 % 256, i, i % 9, i % 900 + 100, i * 13 % 9000 + 1000) for i in range(size // 85))


def test_long_logs_take_time_in_proportion():
    model, took = pii.trained(), []
    for size in (150_000, 300_000, 600_000):
        text = log_lines(size)
        began = time.process_time()
        pii.added_spans(text, pii.base_spans(text), model)
        took.append(time.process_time() - began)
    assert took[2] < 3 * took[1] < 9 * took[0] and took[2] < 30


def test_long_runs_without_a_token_take_time_in_proportion():
    rules = [r.compiled() for r in secret_scan.BASE_RULES + secret_scan.MORE_RULES]
    for text in ("eyJ" * 100_000 + " .eyJ", "eyJ" * 50_000 + ".eyJ" * 50_000, "eyJaaaaaaaa." * 20_000):
        began = time.process_time()
        for rule in rules:
            list(rule.finditer(text))
        assert time.process_time() - began < 2
    token = "eyJhbGciOiJIUzI1NiIs.eyJzdWIiOiIxMjM0NTY.SflKxwRJSMeKKF2QT4"
    assert any(m.group() == token for rule in rules for m in rule.finditer(f"x {token} y"))
