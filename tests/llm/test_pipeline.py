"""The pipeline, stage by stage, each against a plain version over the stage's own input."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm.quality_rules import Bands

from ..conftest import data
from .test_corpus_operators import plain_leaks
from .test_near_copies import plain_components
from .test_text_operators import plain_measures, plain_verdict


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The sample's documents with planted cases, and its benchmark."""
    source, path = data("sf0.001"), str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{source}/documents.parquet")
    bench = spark.read.parquet(f"{source}/benchmark.parquet")
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    item = bench.orderBy("item_id").first()["text"]
    body = [prose(300) for _ in range(4)]
    planted = [
        (90_001, body[0]),
        (90_002, body[0] + " tail"),  # one line each, so the line stage keeps both
        (90_003, body[1] + " " + item + " " + body[2]),
        (90_004, prose(120) + "\nA line that two planted documents share.\n" + prose(120)),
        (90_005, prose(120) + "\na line that two planted documents share. \n" + prose(120)),
        (90_006, "too short"),
        (90_007, None),
        (90_008, "again and again " * 400),
        (None, body[3]),
    ]
    extra = spark.createDataFrame(planted, "doc_id bigint, text string")
    rows = docs.unionByName(extra.withColumn("n_chars", F.length("text").cast("long")), allowMissingColumns=True)
    rows.withColumn("kept", F.lit("mine")).repartition(3).write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What each stage was given and what it gave."""
    out = str(tmp_path_factory.mktemp("stages"))
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{out}/{name}")
        after = spark.read.parquet(f"{out}/{name}")
        seen.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return {name: rest for name, *rest in seen}


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "packing"]
    for name, (_, _, before, after) in stages.items():
        assert name == "packing" or before == after


def test_quality_stage(stages):
    before, after, *_ = stages["quality_rules"]
    kept = set()
    for i, text in texts(before).items():
        n_words, _, _, _, repeated = plain_measures(text)
        if n_words >= 20 and 100 * repeated <= 30 * n_words:
            if plain_verdict(text, Bands())[2]:
                kept.add(i)
    assert set(texts(after)) == kept
    assert {90_001, 90_002, 90_003, 90_004, 90_005, None} <= kept and not {90_006, 90_007, 90_008} & kept
    assert all(texts(after)[i] == texts(before)[i] for i in kept)


def test_line_stage(stages):
    before, after, *_ = stages["line_dedup"]
    table = {i: i + 32 for i in range(65, 91)}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(table)
    holders = defaultdict(set)
    for i, t in texts(before).items():
        if i is not None:
            for line in t.split("\n"):
                holders[key(line)].add(i)
    want = {}
    for i, t in texts(before).items():
        kept = [x for x in t.split("\n") if i is None or len(key(x)) < 10 or min(holders[key(x)]) == i]
        want[i] = "\n".join(kept)
    assert texts(after) == want
    assert "share" in want[90_004] and "share" not in want[90_005]
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_stage(stages):
    before, after, *_ = stages["near_dedup"]
    group = plain_components([(i, t) for i, t in texts(before).items() if i is not None])
    assert set(texts(after)) == {i for i in group if group[i] == i} | {None}
    assert 90_001 in texts(after) and 90_002 not in texts(after)


def test_benchmark_stage(spark, stages, folder):
    before, after, *_ = stages["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    exact = {i for i, t in texts(before).items() if any(x.lower() in (t or "").lower() for _, x in items)}
    gone = set(texts(before)) - set(texts(after))
    assert exact <= gone and 90_003 in gone
    assert gone == {i for i, _ in plain_leaks([(i, texts(before)[i]) for i in gone], items)}


def test_packing_stage(stages):
    before, after, *_ = stages["packing"]
    tokens = defaultdict(int)
    for r in after:
        tokens[r["doc_id"]] += r["length"]
    assert {r["doc_id"]: r["doc_tokens"] for r in after} == tokens and set(tokens) == set(texts(before))
    sequences = defaultdict(list)
    for r in after:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()]


def test_run_gives_what_the_stages_give(spark, stages, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, map(tuple, stages["packing"][1])))


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
