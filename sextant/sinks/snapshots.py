"""Snapshots of explored portfolios: saved, listed, loaded and deleted."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SNAPSHOTS
from ..versions import change, current

LONGEST_NOTE = 200
#: Folders of saved snapshots before they are put together.
MOST_FOLDERS = 50


def save_snapshot(spark: SparkSession, path: str, snapshot: dict, created_at: datetime) -> str:
    """Append one snapshot and return its id; ``snapshot`` has the columns of ``SNAPSHOTS`` but id and time."""
    key = uuid.uuid4().hex
    row = {**snapshot, "id": key, "created_at": created_at, "note": (snapshot.get("note") or "")[:LONGEST_NOTE]}
    fields = spark.createDataFrame([], SNAPSHOTS).schema
    one = spark.createDataFrame([tuple(row.get(f.name) for f in fields)], fields).coalesce(1)

    def add(folders: list[str], new: str) -> list[str]:
        if len(folders) < MOST_FOLDERS:
            one.write.parquet(new)
            return [*folders, new]
        _of(spark, folders).unionByName(one).coalesce(1).write.parquet(new)
        return [new]

    change(spark, path, add)
    return key


def _of(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(SNAPSHOTS).parquet(*folders) if folders else spark.createDataFrame([], SNAPSHOTS)


def _saved(spark: SparkSession, path: str) -> DataFrame:
    return _of(spark, current(spark, path)[1])


def list_snapshots(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """The latest snapshots, newest first."""
    return _saved(spark, path).orderBy(F.desc("created_at"), "id").limit(most)


def delete_snapshot(spark: SparkSession, path: str, key: str) -> None:
    """A version of the table without one snapshot; one that is saved meanwhile stays."""

    def rest(folders: list[str], new: str) -> list[str]:
        _of(spark, folders).where(F.col("id") != key).coalesce(1).write.parquet(new)
        return [new]

    change(spark, path, rest)


def load_snapshot(spark: SparkSession, path: str, key: str) -> dict | None:
    """What a snapshot restores: scheme, universes and basket; thresholds and weights aren't."""
    rows = _saved(spark, path).where(F.col("id") == key).head(1)
    if not rows:
        return None
    return {"scheme": rows[0]["scheme"], "universes": list(rows[0]["universes"]), "basket": [p["t"] for p in rows[0]["picks"]]}
