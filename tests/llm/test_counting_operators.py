"""Toxicity, collocations and the filter audit, each against a plain version or held-out labels."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.llm import collocations, filter_audit, toxicity
from sextant.llm.words import cut_at_ends, words_of

from ..conftest import data

EDGE = [None, "", " ", "\n\n", "a", "é" * 50, "a b " * 4_000, "x" * 30_000, ". , ;", "\x1c \x85 ok", "A B. A B! a b"]


def docs_of(spark, texts, langs=("en", None, "de")):
    """Documents with a repeated row, a null id, and columns whose names the operators use inside."""
    rows = [(i, t, langs[i % len(langs)], "x", 1) for i, t in enumerate(texts)]
    rows += [(0, texts[0], langs[0], "x", 1), (None, "a b a b", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, part string, n int")


# --- words ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBé .,\n\t\x0b", max_size=30), min_size=1, max_size=5))
def test_words_equal_expressions(texts):
    got = words_of([t.encode() for t in texts], collocations.KINDS, collocations.FOLD)
    want = []
    for row, text in enumerate(texts):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        want += [(row, m[0]) for m in re.finditer(r"[^\x20\x09.,;:!?\x0a-\x0d]+", lowered)]
    assert [(r, got.names[i].decode()) for r, i in zip(got.row.tolist(), got.ids.tolist(), strict=True)] == want
    for r, i, a, b in zip(got.row, got.ids, got.start, got.end, strict=True):
        assert texts[r].encode()[a:b].translate(collocations.FOLD) == got.names[i]


def test_long_texts_are_cut_between_pieces():
    raw = b"a b. " * 1000
    parts = list(cut_at_ends(raw, b".", 64))
    assert b".".join(parts) == raw and max(map(len, parts)) <= 64
    assert list(cut_at_ends(b"x" * 500, b".", 64)) == [b"x" * 500]


# --- collocations ---


def plain_collocations(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        rows = []
        for p, a in often.items():
            score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = [n for q, n in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * n >= 100 * a for n in longer):
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


SPOKEN = [" ".join(np.random.default_rng(i).choice(["new", "York", "city", "the", "of", "is.", "Ünder,"], 80)) for i in range(40)]


@pytest.mark.parametrize("least", [1, 3, 9])
def test_collocations_equal_plain_counts(spark, least):
    docs = docs_of(spark, EDGE + SPOKEN)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    mining = collocations.Mining(least=least, top=60)
    got = sorted(tuple(r) for r in collocations.mine_collocations(docs.repartition(3), mining, buckets=4).collect())
    assert got == plain_collocations(rows, least, 60)


def test_full_sketches_lose_nothing(spark):
    """With every cell shared by many n-grams the exact pass still gives the same phrases."""
    docs = docs_of(spark, SPOKEN)
    wide = collocations.mine_collocations(docs, collocations.Mining(least=4))
    narrow = collocations.mine_collocations(docs, collocations.Mining(least=4, most_bits=6))
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, narrow.collect()))


def test_sketch_never_underestimates():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 500, np.uint64)[rng.integers(0, 500, 20_000)]
    sketch = collocations.Sketch(10)
    sketch.add(hashes)
    marks = b"".join(np.packbits(row >= 40, bitorder="little").tobytes() for row in sketch.cells)
    seen, n = np.unique(hashes, return_counts=True)
    assert collocations.Sketch(10, marks).often(seen)[n >= 40].all()


def test_no_rows_no_phrases(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert collocations.mine_collocations(empty).collect() == []
    assert collocations.mine_collocations(docs_of(spark, [None, "", " "])).collect() == []


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", 0, "", 9_000_000_000_000), ("en", 1, "a", 3_000_000_000), ("en", 1, "b", 7), ("en", 2, "a b", 6_999_999_999)],
        "lang string, k int, phrase string, n long",
    )
    row = collocations._scored(counts).first()
    assert row["score"] == 1000 * 6_999_999_999 * 9_000_000_000_000 // (3_000_000_000 * 7)


# --- filter audit ---


def plain_audit(docs, labels):
    least = {}
    for doc, text, _ in docs:
        key = (doc is None, doc)
        least[text or ""] = min(least.get(text or "", key), key)
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    masks = []
    for doc, text, lang in docs:
        x = text or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", x)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", x)) > 3 * len(x),
            "D": bool(re.search("[#$%&*|]", x)),
            "E": least[x] < (doc is None, doc),
        }
        masks.append((lang or "", {k for k, v in fails.items() if v}, doc is not None and doc in good, doc is not None and doc in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        rows = [m for m in masks if m[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step in range(1, 6):
                name, earlier = order[step - 1], set(order[: step - 1])
                here = [m for m in rows if name in m[1] and not m[1] & earlier]
                shapley[name] += len(here)
                out[part, "".join(order), step] = [
                    sum(not m[1] & (earlier | {name}) for m in rows),
                    len(here),
                    sum(name in m[1] and bool(m[1] & earlier) for m in rows),
                    sum(m[1] == {name} for m in rows),
                    sum(m[2] for m in here),
                    sum(m[3] for m in here),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


LONG = " ".join(f"word{i}" for i in range(220))


def test_audit_equals_plain_version(spark):
    texts = EDGE + [LONG, LONG, LONG + " #", LONG.upper(), "a " * 300, "ÀB", LONG, "", None]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame(
        [(i, i % 2, int(i % 3 == 0), "z") for i in range(0, 18)] + [(1, None, 1, "z"), (None, 1, 1, "z"), (2, 1, None, "z"), (999, 1, 1, "z")],
        "doc_id bigint, quality int, toxic int, lang string",
    )
    rows = filter_audit.audit_filters(docs.repartition(5), labels).collect()
    want = plain_audit([tuple(r)[:3] for r in docs.collect()], [tuple(r)[:3] for r in labels.collect()])
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in rows} == want and len(rows) == len(want) == 3 * 600


def test_copies_are_found_across_tasks_and_collisions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}", "en") for i in range(300)], "doc_id int, text string, lang string")
    found = filter_audit.failed_filters(docs.repartition(7)).where(F.col("mask").bitwiseAND(filter_audit.COPY) > 0)
    assert sorted(r["doc_id"] for r in found.collect()) == [i for i in range(300) if i % 3 and i != 1]
    chains = filter_audit.Chains()
    for i, raw in enumerate([b"x", b"y", b"x", b"y", b"x"]):
        lost = chains.offer(7, raw, (10 - i, 0, {"": 1}))
        assert (lost is None) == (i < 2)
    assert sorted((raw, claim[0]) for _, raw, claim in chains.drain()) == [(b"x", 6), (b"y", 7)]


def test_audit_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_filters(empty, labels).collect() == []


# --- toxicity ---


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{data('sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity_digest(docs, labels)
    assert out.count() == docs.count()
    seen = out.join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").toPandas()
    rank, y = seen.score.rank().to_numpy(), seen.toxic.to_numpy()
    area = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert area > 0.95 and seen.predicted[y == 1].mean() > 0.8 and seen.predicted[y == 0].mean() < 0.01


TOXIC = "Here is a calm line. You utter knave! The weather is fine.\nMore calm words follow. "


def labelled(spark, n=200):
    texts = [TOXIC if i % 2 else "Here is a calm line. The weather is fine.\nMore calm words follow. " for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))


def test_offending_sentences_are_located(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_model(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    for r in rows:
        assert (r["score"] >= 0.5) == bool(r["doc_id"] % 2)
        assert [TOXIC[s["start"] : s["end"]] for s in r["offending"]] == (["You utter knave"] if r["doc_id"] % 2 else [])
    long = spark.createDataFrame([(1, "Ä calm line. " * 100_000 + TOXIC)], "doc_id bigint, text string")
    row = toxicity.score_toxicity(long, model).first()
    assert ("Ä calm line. " * 100_000 + TOXIC)[row["worst_start"] : row["worst_end"]] == "You utter knave"


def test_noisy_or_of_sentences(spark):
    model = toxicity.Model({"bad$": 3.0}, -2.0)
    texts = ["bad. ok. BAD bad!", "", None, "...", "fine"]
    got = [r["score"] for r in toxicity.score_toxicity(docs_of(spark, texts), model).collect()]
    p = [1 / (1 + np.exp(-z)) for z in (1.0, -2.0)]
    want = [1 - (1 - p[0]) ** 2 * (1 - p[1]), p[1], p[1], p[1], p[1], 1 - (1 - p[0]) ** 2 * (1 - p[1]), p[1]]
    assert got == pytest.approx(want)


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_model(docs, labels) == toxicity.fit_model(docs, flipped)


def test_toxicity_edges(spark):
    docs, labels = labelled(spark)
    out = toxicity.toxicity_digest(docs_of(spark, EDGE), labels.limit(0))
    assert out.count() == len(EDGE) + 2 and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.toxicity_digest(docs.limit(0), labels).collect() == []
