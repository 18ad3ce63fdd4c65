"""The operators that compare or place documents, each against a plain version."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.llm import decontamination, line_dedup, packing, resharding, simhash
from sextant.llm.common import connected_components, dense_rank_in_key

from ..conftest import data

EDGE = [None, "", " \t\n", "One", "one ONE one", "É é", "a b c d", "A B\x0bC\x1cd e", "word " * 60_000, "z" * 200_000]


def docs_of(spark, texts, extra=True):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    if extra:  # names that the operators use inside
        docs = docs.withColumn("fp", F.lit("x")).withColumn("size", F.lit(1)).withColumn("n_lines", F.array(F.lit(1)))
    return docs


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


# --- SimHash ---


def plain_fingerprint(text):
    table = {i: i + 32 for i in range(65, 91)}
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(table))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fp, radius):
    """Components by the full matrix of distances."""
    ids = sorted(fp)
    values = np.array([fp[i] for i in ids], np.uint64)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[:k] ^ values[k]) <= radius):
            a, b = root(i), root(ids[j])
            label[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_copies(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    base = [rnd.choice(words) for _ in range(400)]
    texts = [" ".join(base)] * 3
    for n in (1, 1, 2, 3, 40):
        copy = list(base)
        for _ in range(n):
            copy[rnd.randrange(400)] = "new"
        texts.append(" ".join(copy))
    return texts + [" ".join(rnd.choice(words) for _ in range(100)) for _ in range(20)]


def test_simhash_against_all_pairs(spark):
    texts = EDGE[:8] + near_copies(1) + [r["text"] for r in spark.read.parquet(f"{data('sf0.001')}/documents.parquet").collect()]
    rows = simhash.simhash_components(docs_of(spark, texts)).collect()
    fp = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    group = plain_groups(fp, 4)
    assert sorted(map(tuple, rows)) == [(i, format(fp[i], "016x"), group[i]) for i in range(len(texts))]
    long = simhash.simhash_components(docs_of(spark, EDGE)).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in long} == {i: plain_fingerprint(t) for i, t in enumerate(EDGE)}


def random_reps(seed, n=1500):
    """Fingerprints in clusters and chains, many in the same tile."""
    rnd = np.random.default_rng(seed)
    seeds = rnd.integers(0, 2**64, 40, np.uint64)
    out = []
    for k in range(n):
        bits = rnd.choice(64, int(rnd.integers(0, 7)), replace=False)
        out.append(int(seeds[k % 40]) ^ sum(1 << int(b) for b in bits))
    return sorted(set(out))


@pytest.mark.parametrize("chunk, parts", [(1 << 16, None), (7, None), (1 << 16, 6), (7, 7)])
def test_tiles_lose_no_link(spark, monkeypatch, chunk, parts):
    monkeypatch.setattr(simhash, "CELL", 16)
    values = random_reps(chunk)
    signed = [(v - 2**64 if v >= 2**63 else v, i) for i, v in enumerate(values)]
    reps = spark.createDataFrame(signed, "fp bigint, rep bigint").repartition(3)
    got = {r["vertex"]: r["component"] for r in connected_components(simhash.near_links(reps, 4, chunk, parts)).collect()}
    want = plain_groups(dict(enumerate(values)), 4)
    assert {i: got.get(i, i) for i in want} == want


@pytest.mark.parametrize("slots", [1, 64])
def test_copies_of_a_fingerprint_do_not_grow_with_the_corpus(spark, monkeypatch, slots):
    """Cells get more with the fingerprints, and each is sent radius + 1 times whatever their number."""
    rnd = np.random.default_rng(4)
    monkeypatch.setattr(simhash, "CELL", 20_000 // slots)
    for n in (2000, 20_000):
        values = rnd.integers(-(2**63), 2**63, n, np.int64).tolist()
        reps = spark.createDataFrame(list(zip(values, range(n), strict=True)), "fp bigint, rep bigint")
        dealt = simhash.in_cells(reps, 4)
        assert dealt.count() == 5 * n
    cells = dealt.select("cell").distinct().count()
    assert cells >= 5 * slots


def test_cells_keep_their_size():
    """On average from a million fingerprints to a million times as many, at a bounded number of copies."""
    sizes = {n: simhash.layout(n) for n in (10**k for k in range(6, 13))}
    assert all(n / slots <= simhash.FULL_CELL for n, (_, slots) in sizes.items())
    assert [parts for parts, _ in sizes.values()] == [5, 5, 5, 6, 6, 7, 7]


def test_cells_of_more_parts(spark):
    """A fingerprint is in a cell for each choice of parts."""
    reps = spark.createDataFrame([(int(v), i) for i, v in enumerate(np.random.default_rng(9).integers(-(2**63), 2**63, 500))], "fp bigint, rep bigint")
    for parts, copies in ((5, 5), (6, 15), (7, 35)):
        assert simhash.in_cells(reps, 4, parts=parts).count() == copies * 500


def test_tiles_compare_what_their_counts_allow():
    rnd = np.random.default_rng(3)
    fp = rnd.integers(0, 2**64, (3000, 2), np.uint64)
    other = fp[:300] ^ np.array([0b1011, 1 << 60], np.uint64)
    other[200:, 0] ^= np.uint64(0xFFFFF)
    found = set(simhash._Tiles(fp, np.arange(3000), 4, 3).links(other, np.arange(5000, 5300)))
    assert found == {(5000 + i, i) for i in range(200)}
    one = simhash._Tiles(fp[:, :1], np.arange(3000), 20, 20)
    got = {tuple(sorted(e)) for e in one.links(fp[:, :1], np.arange(3000))}
    links = plain_groups(dict(enumerate(fp[:, 0].tolist())), 20)
    label = list(range(3000))
    for _ in range(60):
        for a, b in got:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(enumerate(label)) == links


def test_simhash_edge_rows(spark):
    assert simhash.simhash_components(empty(spark)).count() == 0
    rows = [(5, "same text here now"), (3, "same text here now"), (3, "same text here now"), (None, "same text here now"), (None, "else where it is not"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.simhash_components(docs).collect() if r["doc_id"] or r["component_id"])
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3), (9, 9)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {v: c for v, c in label.items() if sum(c == x for x in label.values()) > 1}


@pytest.mark.parametrize("many", [2, None])
def test_components_with_hubs(spark, many):
    """Stars, a chain of hubs and pairs; with ``many`` of 2 most vertices are hubs."""
    stars = [(9000 + h, 100 * h + k) for h in range(3) for k in range(60)]
    edges = [*stars, (9000, 9001), (8000, 8001), *[(5000 + k, 5001 + k) for k in range(12)]]
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    got = {r["vertex"]: r["component"] for r in connected_components(frame, many).collect()}
    assert set(got) == {v for e in edges for v in e}
    assert {got[v] for v in got if v < 200 or v in (9000, 9001)} == {0} and {got[v] for v in range(200, 260)} == {200} == {got[9002]}
    assert {got[v] for v in range(5000, 5013)} == {5000} and got[8001] == 8000


# --- lines ---


def plain_lines(rows):
    table = {i: i + 32 for i in range(65, 91)}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(table)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


LINES = [
    (4, "a shared line of text\nown line of four here\n\n short\nA SHARED LINE OF TEXT  "),
    (2, "\t A shared LINE of text\r\nÉCOLE ÉCOLE É\nécole école é\nninechars\n"),
    (7, "ÉCOLE ÉCOLE É\nninechars\na shared line of text"),
    (7, "ÉCOLE ÉCOLE É\nanother row of seven"),
    (None, "a shared line of text\n"),
    (1, None),
    (3, ""),
    (9, "a shared line of text"),
    (9, "a shared line of text"),
    (8, "x" * 100_000 + "\n" + "y" * 10 + "\n" * 5000),
    (6, "y" * 10),
]


def test_lines(spark):
    docs = spark.createDataFrame(LINES, "doc_id bigint, text string")
    assert Counter(map(tuple, line_dedup.line_digest(docs.withColumn("kept_text", F.lit(1))).collect())) == plain_lines(LINES)
    assert line_dedup.line_digest(empty(spark)).count() == 0
    three = line_dedup.dedup_lines(docs, min_docs=5).agg(F.sum("n_dropped")).first()[0]
    assert three == 0
    assert line_dedup.dedup_lines(docs, min_docs=3).where("doc_id = 7").agg(F.sum("n_dropped")).first()[0] == 1


def test_lines_equal_their_sql(spark):
    path = f"{data('sf0.001')}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    want = con.execute(line_dedup.DIGEST_SQL).fetchall()
    docs = spark.read.parquet(path)
    assert Counter(map(tuple, line_dedup.line_digest(docs).collect())) == Counter(want)
    assert Counter(want) == plain_lines([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_dropping_lines_keeps_columns(spark):
    docs = spark.createDataFrame([(i, t, 99, "z") for i, t in LINES], "doc_id bigint, text string, n_chars bigint, kept_text string")
    out = line_dedup.drop_repeated_lines(docs)
    assert out.dtypes == docs.dtypes and out.count() == len(LINES)
    row = out.where("doc_id = 4").first()
    assert row["text"] == "own line of four here\n\n short" and row["n_chars"] == len(row["text"])
    assert out.where("doc_id = 1").first()["text"] is None and out.where("doc_id = 2").first()["n_chars"] == 99


def test_lines_with_columns_of_any_name(spark):
    """Columns named like those the operator adds or uses inside keep their values."""
    names = ["n_lines", "n_dropped", "kept_text", "__doc", "doc", "same", "gone", "lines", "kept", "c0", "in_doc", "h1"]
    rows = [(i, t, *range(n, n + len(names))) for n, (i, t) in enumerate(LINES)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    plain = line_dedup.drop_repeated_lines(spark.createDataFrame(LINES, "doc_id bigint, text string"))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(map(tuple, plain.collect()))
    assert sorted(tuple(r)[2:] for r in out.collect()) == [r[2:] for r in rows]
    added = line_dedup.dedup_lines(docs)
    assert added.columns == ["doc_id", "text", *names[3:], *names[:3]]
    four = added.where("doc_id = 4").first()
    assert (four["n_lines"], four["n_dropped"], four["kept_text"]) == (5, 2, "own line of four here\n\n short")


# --- benchmark ---


def plain_leaks(texts, items, edits=decontamination.EDITS):
    """Least edit distance of each item to any run of a text's words, where it is small enough."""
    out = {}
    for d, text in texts:
        words = decontamination.words_of(text)
        for i, item in items:
            target = decontamination.words_of(item)
            most = int(edits * len(target))
            if not target:
                continue
            row = [0] * (len(words) + 1)
            for n, x in enumerate(target, 1):
                new = [n]
                for j, y in enumerate(words, 1):
                    new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
                row = new
            if min(row) <= most:
                out[d, i] = min(row)
    return out


def leak_case(seed=2, docs=120):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(600)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(8, 60)))) for i in range(40)]
    items += [(40, items[0][1]), (41, "too short"), (42, None), (None, "no id of its own at all here"), (43, "")]
    texts = [(1000, None), (1001, ""), (1002, "!!! ... ---"), (1003, items[3][1].upper().replace(" ", "!! "))]
    for d in range(docs):
        body = [rnd.choice(words) for _ in range(rnd.randint(0, 200))]
        if d % 3:
            copy = items[rnd.randrange(40)][1].split()
            for _ in range(rnd.randint(0, int((0.0, 0.1, 0.2)[d % 3] * len(copy)))):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.randint(0, 1)] = ["edited"] * rnd.randint(0, 1)
            at = rnd.randint(0, len(body))
            body[at:at] = copy
        texts.append((d, " ".join(body)))
    return texts, items


def test_leaks_against_brute_force(spark):
    texts, items = leak_case()
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in decontamination.find_leaks(docs, bench).collect()}
    want = plain_leaks(texts, [(i, t) for i, t in items if i is not None])
    assert len(want) > 70 and set(got) <= set(want)
    assert all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.95 * len(want)
    exact = {k for k, n in want.items() if n == 0}
    assert exact <= set(got) and all(got[k] == 0 for k in exact)
    assert (1003, 3) in got
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in got}


def test_items_in_several_passes(spark, monkeypatch):
    texts, items = leak_case(docs=30)
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = {tuple(r)[:2] for r in decontamination.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "ITEMS_PER_PASS", 7)
    rows = decontamination.find_leaks(docs, bench.unionByName(bench)).collect()
    passes = {tuple(r)[:2] for r in rows}
    assert len(rows) == len(passes)
    exact = {k for k, n in plain_leaks(texts, [(i, t) for i, t in items if i is not None]).items() if n == 0}
    assert exact <= passes and len(passes ^ whole) <= 0.1 * len(whole)


def test_leaks_of_nothing(spark):
    texts, items = leak_case(docs=3)
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert decontamination.find_leaks(empty(spark), bench).count() == 0
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    twice = decontamination.find_leaks(docs.unionByName(docs), bench)
    assert twice.count() == 2 * decontamination.find_leaks(docs, bench).count()


def test_exact_leaks_of_the_sample(spark):
    folder = data("sf0.01")
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {tuple(r)[:2] for r in decontamination.find_leaks(docs, bench).collect()}
    items = [(r["item_id"], r["text"].lower()) for r in bench.collect()]
    inside = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in r["text"].lower()}
    assert inside and got == inside


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), max_size=14)), min_size=1, max_size=5))
def test_edit_distances(pairs):
    best = [min(levenshtein(item, window[:j]) for j in range(len(window) + 1)) for item, window in pairs]
    items, windows = (np.array([[*x, *[0] * (n - len(x))] for x in side]) for side, n in zip(zip(*pairs, strict=True), (12, 40), strict=True))
    for most in (0, 2, 20):
        got = decontamination.edit_distances(items, np.array([len(i) for i, _ in pairs]), windows, most)
        assert got.tolist() == [min(b, most + 1) for b in best]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# --- packing ---


def check_packing(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    rows = packing.pack_documents(docs, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["length"] == len(part) and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        assert sum(n for _, n in own) == len(ids[i]) and all(s == sum(n for t, n in own if t < s) for s, _ in own)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(map(len, ids.values())), len(sequences)


ODD = [None, "", " ", "  two  spaces ", " lead", "tail ", "a\n\n b\t c", "<|endoftext|> x", "don't we'll 12345 ½²٣ \x1c\x85    nb", "é漢字🙂", "word " * 9000, "x" * 5000]


def test_packing_odd_texts(spark):
    check_packing(spark, docs_of(spark, ODD), list(enumerate(ODD)))
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_sample(spark):
    docs = spark.read.parquet(f"{data('sf0.001')}/documents.parquet")
    total, sequences = check_packing(spark, docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert total > 0.97 * 2048 * sequences


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "x")], "doc_id bigint, text string")
    rows = packing.pack_documents(docs).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_patterns_use_every_piece(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    used = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 64 and list(pattern) == sorted(pattern, reverse=True)
        for length in pattern:
            used[length] += count
    assert used == Counter(histogram)
    plain = []  # the same by single packs
    for length in sorted(Counter(histogram).elements(), reverse=True):
        plain.sort()
        if plain and plain[0] + length <= 64:
            plain[0] += length
        else:
            plain.append(length)
    assert sum(c for _, c in patterns) == len(plain)
    seen = set()
    for length, low, high, first, offset in packing.placements(patterns):
        for k in range(high - low):
            seen.add((length, low + k, first + k, offset))
    assert len({s[:2] for s in seen}) == len(seen) == sum(histogram.values())


def test_ranks_are_gapless(spark):
    rows = [("a", i % 7) for i in range(500)] + [("b", 1), (None, 2), (None, 2)]
    ranked = dense_rank_in_key(spark.createDataFrame(rows, "k string, v int"), "k", ["v"], "n", 5)
    by = defaultdict(list)
    for r in ranked.collect():
        by[r["k"]].append(r["n"])
    assert {k: sorted(v) for k, v in by.items()} == {"a": list(range(500)), "b": [0], None: [0, 1]}


# --- shards ---


def test_shards(spark):
    texts = EDGE[:8] + ["the same text"] * 400 + [f"text number {i} " * (i % 40) for i in range(1200)]
    rows = resharding.shard_digest(docs_of(spark, texts)).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and set(sizes) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 16
    assert max(sizes.values()) < 1.03 * mean and min(sizes.values()) > 0.97 * mean
    assert resharding.shard_digest(empty(spark)).count() == 0


def test_equal_texts_share_a_shard(spark):
    docs = spark.read.parquet(f"{data('sf0.1')}/documents.parquet").select("doc_id", "text")
    hot = spark.range(3000).select((F.col("id") + 10**6).alias("doc_id"), F.repeat(F.lit("one text of many rows "), 40).alias("text"))
    placed = resharding.shard_digest(docs.union(hot)).select("doc_id", "shard").join(docs.union(hot), "doc_id")
    assert placed.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256)).agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_shards_with_columns_of_any_name(spark):
    names = ["__size", "__old", "__block", "bytes", "old", "new", "piece", "c1", "h_old"]
    rows = [(i, f"text {i % 50} " * 20, i % 3, *range(i, i + len(names))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int, " + ", ".join(f"{n} int" for n in names))
    out = resharding.reshard(docs, 4)
    assert out.columns == [*docs.columns[:3], *names[2:], "__size", "__old", "__new"]
    assert sorted(tuple(r)[3:10] for r in out.collect()) == [r[5:] for r in rows]
    assert all(r["__size"] == len(r["text"]) + 1 for r in out.collect())


def test_sample_shards_are_near_equal(spark):
    docs = spark.read.parquet(f"{data('sf0.1')}/documents.parquet")
    sizes = [r["b"] for r in resharding.shard_digest(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.005 * min(sizes)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=5), st.integers(1, 5))
def test_flow_moves_the_least(supply, shards):
    capacity = resharding.near_equal(sum(supply), shards)
    price = [[int(i != j) for j in range(shards)] for i in range(len(supply))]
    flow = resharding.min_cost_flow(supply, capacity, price)
    assert [sum(f) for f in flow] == supply and [sum(f[j] for f in flow) for j in range(shards)] == capacity
    moved = sum(flow[i][j] for i in range(len(supply)) for j in range(shards) if i != j)
    stay = sum(min(supply[j], capacity[j]) for j in range(min(shards, len(supply))))
    assert moved == sum(supply) - stay


def test_flow_follows_the_price():
    flow = resharding.min_cost_flow([10, 0, 0], [4, 3, 3], [[0, 5, 1], [5, 0, 1], [1, 1, 0]])
    assert flow == [[4, 3, 3], [0, 0, 0], [0, 0, 0]]
    cheap = resharding.min_cost_flow([6, 6], [6, 6], [[9, 1], [1, 9]])
    assert cheap == [[0, 6], [6, 0]]
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [4], [[0]])


def test_only_affected_shards_are_rewritten(spark, tmp_path):
    rows = [(i, f"text {i} " * 20, i % 3 if i < 300 else 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    changed, whole = resharding.rewrite_affected(docs, str(tmp_path / "new"), 3)
    assert changed == [0, 1, 2] and {r["doc_id"] for r in whole.collect()} == set(range(400))
    sizes = [r["b"] for r in whole.groupBy("shard").agg(F.sum(F.length("text")).alias("b")).collect()]
    assert len(sizes) == 3 and max(sizes) < 1.1 * min(sizes)
    balanced, same = resharding.rewrite_affected(whole.cache(), str(tmp_path / "again"), 3)
    moved = whole.join(same.withColumnRenamed("shard", "now"), "doc_id").where("shard <> now").count()
    assert moved < 40
    fewer, left = resharding.rewrite_affected(docs, str(tmp_path / "fewer"), 2)
    assert {r["shard"] for r in left.select("shard").distinct().collect()} == {0, 1} and left.count() == 400 and 2 in fewer
