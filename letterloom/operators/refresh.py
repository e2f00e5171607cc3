"""What changed between a listing and what is stored, and tables brought up to date by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(files: DataFrame, docs: DataFrame, key: str = "path") -> DataFrame:
    """The listing plus ``state``: new, changed (stored stamp older) or unchanged."""
    known = docs.select(key, F.col("stamp").alias("stored_stamp"))
    state = (
        F.when(F.col("stored_stamp").isNull(), "new")
        .when(F.col("stored_stamp") >= F.col("stamp"), "unchanged")
        .otherwise("changed")
    )
    return files.join(known, key, "left").withColumn("state", state).drop("stored_stamp")


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """Stored rows without those that have a fresh version, plus the fresh rows."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def stale(docs: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Stored rows whose file is gone."""
    return docs.join(files.select(key), key, "left_anti")


def kept(docs: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Stored rows whose file is still there."""
    return docs.join(files.select(key), key, "left_semi")


def newest(rows: DataFrame, key: list[str] | str, stamp: str, *tie_break: str) -> DataFrame:
    """The newest row of each key. Each partition passes on one row per key at most."""
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*keys).orderBy(F.desc(stamp), *tie_break)
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def apply_tombstones(messages: DataFrame, tombstones: DataFrame, key: list[str] | str) -> DataFrame:
    """Messages without those that were deleted at the source."""
    keys = [key] if isinstance(key, str) else key
    return messages.join(tombstones.select(*keys), keys, "left_anti")
