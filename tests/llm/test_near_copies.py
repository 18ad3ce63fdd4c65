"""The near-duplicate stage against all pairs of five-word shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import simhash

from ..conftest import data


def plain_components(texts):
    """``{doc_id: smallest id of its group}`` by comparing every pair of sets that share a shingle."""
    sets, holders = {}, {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in {j for s in sets[i] for j in holders[s] if j < i}:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def edited(rnd, words, edits):
    out = list(words)
    for at in rnd.sample(range(10, len(out) - 10), edits):
        out[at] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


def test_stage_drops_copies_down_to_the_similarity(spark):
    rnd = random.Random(3)
    bodies = [[f"w{rnd.randrange(5000)}" for _ in range(400)] for _ in range(30)]
    rows = [(2 * k + n, t) for k, b in enumerate(bodies) for n, t in enumerate((" ".join(b), edited(rnd, b, 7)))]
    want = plain_components(rows)
    assert sum(i != c for i, c in want.items()) == 30  # each pair lies between 0.8 and 0.9
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id bigint, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}
    assert kept.columns == docs.columns


@pytest.mark.parametrize("pieces", [False, True])
def test_groups_against_all_pairs(spark, monkeypatch, pieces):
    """With ``pieces``, bands and groups are cut to many small tasks."""
    rnd = random.Random(5)
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data('sf0.01')}/documents.parquet").collect()]
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    texts += [(50_000 + k, edited(rnd, base, 2)) for k in range(60)]  # one large group
    texts += [(60_000 + k, edited(rnd, base, 14)) for k in range(30)]  # near the group, mostly not in it
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    if pieces:
        monkeypatch.setattr(simhash, "CHUNK", 50)
    most = 3000 if pieces else simhash.MOST_HASHES
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs, most_hashes=most).collect()}
    assert got == plain_components(texts)


def test_pairs_at_the_similarity_are_proposed(spark):
    """Pairs just over 0.8: the fingerprints' radius reaches nearly all."""
    rnd = random.Random(8)
    rows = []
    for k in range(300):
        body = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        rows += [(2 * k, " ".join(body)), (2 * k + 1, edited(rnd, body, 4))]
    want = {i for i, c in plain_components(rows).items() if i != c}
    got = {r["doc_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc_id <> component_id").collect()}
    assert len(want) > 200 and got <= want and len(got) >= 0.95 * len(want)


def test_few_shingles_against_all_pairs(spark):
    """Texts of one to ten shingles and those with a word more or less at an end: none is missed."""
    rnd = random.Random(12)
    rows = []
    for _ in range(400):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(5, 15))]
        rows += [" ".join(w) for w in (words, words[1:], [*words, "more"], words[:-1]) if rnd.random() < 0.8]
    rows = list(enumerate(rows))
    want = plain_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(i != c for i, c in want.items()) > 400 and got == want


def test_subset_links_with_a_hub(spark, monkeypatch):
    """A set that many others hold, with and without broadcast; sets that only share a missing subset aren't linked."""
    content = lambda *x: simhash.content_of(np.array(x, np.uint64))
    sets = [(7, 8, 9, 10), *[(7, 8, 9, 10, 11 + k) for k in range(40)], (1, 2, 3, 4, 50), (1, 2, 3, 4, 60), (20, 21, 22), (20, 21, 22, 23)]
    rows = [(content(*s), i, len(s), simhash.shorter_contents(np.array(s, np.uint64))) for i, s in enumerate(sets)]
    reps = spark.createDataFrame(rows, "content bigint, rep bigint, n bigint, shorter array<bigint>")
    for many in (2, 1000):
        monkeypatch.setattr(simhash, "MANY_NEIGHBOURS", many)
        assert sorted(map(tuple, simhash.subset_links(reps).collect())) == [(k, 0) for k in range(1, 41)]


@pytest.mark.parametrize("common, one, two", [(8, 1, 0), (8, 1, 1), (12, 2, 1), (20, 3, 2), (400, 50, 50)])
def test_share_of_pairs_that_fingerprints_propose(common, one, two):
    """At similarity 0.8 to 0.89, where subsets don't decide."""
    rnd = np.random.default_rng(common)
    near = 0
    for _ in range(1000):
        sets = rnd.integers(0, 2**64, common + one + two, np.uint64)
        pair = [sets[: common + one], np.r_[sets[:common], sets[common + one :]]]
        first, second = (np.bitwise_count(np.bitwise_xor(*simhash.majority_bits(p))) for p in (pair, [simhash._mixed(x) for x in pair]))
        near += first <= simhash.SET_FIRST and int(first) + int(second) <= simhash.SET_RADIUS
    assert near >= 970


def test_least_shingles_agree_as_often_as_sets_do():
    """In each order by itself, as a share of many pairs of a known similarity."""
    rnd = np.random.default_rng(4)
    agree = []
    for _ in range(1500):
        both, one, two = (rnd.integers(0, 2**64, n, np.uint64) for n in (160, 20, 20))
        agree.append(simhash.least_shingles(np.r_[both, one]) == simhash.least_shingles(np.r_[both, two]))
    share = np.mean(agree, axis=0)
    assert len(share) == simhash.KEYS and (abs(share - 0.8) < 0.04).all()
    assert (~np.any(agree, axis=1)).mean() < 0.003  # 0.2 ** 6 where the orders are independent
    assert not len(simhash.least_shingles(np.empty(0, np.uint64)))


def test_copies_of_a_set_do_not_grow(spark):
    """Sets are sent once for each order; where a third share a shingle, those go to the pieces of one cell more."""
    least = lambda hot: F.array(hot, *[F.xxhash64("id", F.lit(k)) for k in range(1, simhash.KEYS)])
    for n in (2000, 20_000):
        sets = spark.range(n).select(F.col("id").alias("rep"), F.xxhash64("id").alias("fp"), F.xxhash64("id", F.lit(9)).alias("fp2"), "id")
        assert simhash.sets_in_cells(sets.withColumn("least", least(F.col("id")))).count() == simhash.KEYS * n
        hot = sets.withColumn("least", least(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))))
        dealt = simhash.sets_in_cells(hot).groupBy("cell", "one", "two").count()
        total, most = dealt.agg(F.sum("count"), F.max("count")).first()
        assert total <= (simhash.KEYS + 64 / 3 / 3 + 1) * n and most <= 3 * max(simhash.SMALL_CELL, n // 64)


def test_rows_at_the_edge(spark):
    rows = [(5, "same text here now"), (3, "Same text  here now"), (3, "else where it is"), (9, None), (8, " "), (7, "else where it is"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs).collect()}
    assert got == {(5, 3), (3, 3), (7, 3), (8, 8), (9, 8)}
    kept = simhash.drop_near_duplicates(docs.withColumn("component_id", F.lit("c")).withColumn("__gone", F.lit(1)))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("3", "Same text  here now"), ("3", "else where it is"), ("8", " "), ("None", "x")])
    assert kept.columns == ["doc_id", "text", "component_id", "__gone"]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
