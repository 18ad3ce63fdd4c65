"""The corpus queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import COLLOCATIONS_SQL, mine_collocations
from .common import table
from .decontamination import find_leaks
from .filter_audit import AUDIT_SQL, audit_filters
from .html_text import extract_main_text
from .line_dedup import DIGEST_SQL, line_digest
from .packing import pack_documents
from .pii import scan_personal_data
from .quality_rules import score_fitted
from .resharding import shard_digest
from .secret_scan import scan_secrets
from .simhash import simhash_components
from .token_counts import count_tokens
from .toxicity import toxicity_digest


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, found through trigram postings."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under the unigram model."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents contain."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that several documents share, dropped from all but one of them."""
    return line_digest(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, with the mentions that the random field adds."""
    return scan_personal_data(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return shard_digest(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word measures and the verdict of the compression bands, fitted on labels, for all documents."""
    return score_fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that aren't held out."""
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language in all documents."""
    return mine_collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_html_text": op8_html_text,
    "op9_sharding": op9_sharding,
    "op10_quality_rules": op10_quality_rules,
    "op11_toxicity": op11_toxicity,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": DIGEST_SQL,
    "op12_collocations": COLLOCATIONS_SQL,
    "op13_filter_audit": AUDIT_SQL,
}
