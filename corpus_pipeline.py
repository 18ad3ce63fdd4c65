"""The training-corpus pipeline: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sextant.llm.common import shared_folder, table
from sextant.llm.decontamination import drop_contaminated
from sextant.llm.line_dedup import drop_repeated_lines
from sextant.llm.packing import pack_documents
from sextant.llm.quality_rules import fit_bands, keep_good
from sextant.llm.simhash import drop_near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules and the compression bands, fitted on labels, accept."""
    return keep_good(docs, fit_bands(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id has too."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar five-word shingle sets: the one of smallest id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL has neither zstandard nor XXH64 nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def _stage_folder(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/stages-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what the last returns.

    A stage's table is removed once the next one is written; the table that the last
    stage reads stays, as its result is lazy.
    """
    folder = _stage_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return out
        path = f"{folder}/{number}-{name}"
        out.write.parquet(path)
        if number:
            _delete(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
        docs = spark.read.parquet(path)
    return docs
