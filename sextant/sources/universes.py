"""Universe configuration and symbol lists."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.universe import clean_tickers, constituent_symbols
from ..params import Universe
from ..schemas import UNIVERSES_FILE

log = logging.getLogger(__name__)


def read_universes(spark: SparkSession, path: str) -> DataFrame:
    """``(id, label, benchmark, source, text_sources, tickers)`` of a configuration file, one row per universe."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", UNIVERSES_FILE)).alias("id", "u"))
    return parsed.select("id", "u.label", "u.benchmark", "u.source", F.col("u.txtSources").alias("text_sources"), "u.tickers")


def read_universe(spark: SparkSession, path: str, wanted: str) -> Universe:
    """One universe by id; raises ``ValueError`` for an unknown one."""
    rows = read_universes(spark, path).where(F.col("id") == wanted).head(1)
    if not rows:
        raise ValueError(f"unknown universe {wanted}")
    r = rows[0]
    return Universe(r["id"], r["label"], r["benchmark"], r["source"], tuple(r["text_sources"] or ()), tuple(r["tickers"] or ()))


def load_symbols(spark: SparkSession, universe: Universe) -> DataFrame:
    """``(symbol)`` of a universe: its text lists or its table, and its own symbols.

    A text list that can't be read is logged and left out; of a table that can't be
    read only the configured symbols are left.
    """
    own = spark.createDataFrame([(t,) for t in universe.tickers], "symbol string")
    if universe.text_sources:
        lists = []
        for path in universe.text_sources:
            try:
                lists.append(clean_tickers(spark.read.text(path)))
            except AnalysisException as error:
                log.warning("%s: list %s left out: %s", universe.id, path, error)
        found = reduce(lambda a, b: a.unionByName(b), lists).distinct() if lists else spark.createDataFrame([], "symbol string")
        return found.unionByName(own)
    if universe.source:
        try:
            rows = spark.read.option("header", True).csv(universe.source)
            named = {c.strip().lower(): c for c in rows.columns}
            if "symbol" in named:
                return constituent_symbols(rows, named["symbol"]).unionByName(own)
            log.warning("%s: no symbol column in %s", universe.id, universe.source)
        except AnalysisException as error:
            log.warning("%s: %s can't be read: %s", universe.id, universe.source, error)
    return own
