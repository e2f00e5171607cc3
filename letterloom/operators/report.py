"""Counts and totals of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions.bytes import format_bytes

# Rows that a block of a running total should hold, and most blocks of a folder.
BLOCK_ROWS = 100_000
MOST_BLOCKS = 1 << 16


def load_report(rows: DataFrame) -> DataFrame:
    """Per folder: number of messages, total size, and the size in readable form."""
    totals = rows.groupBy("folder").agg(F.count("*").alias("messages"), F.sum("size").alias("bytes"))
    return totals.withColumn("size_text", format_bytes(F.col("bytes")))


def folder_counts(folders: DataFrame, messages: DataFrame) -> DataFrame:
    """Message count of every folder that can hold messages, empty ones included."""
    counts = messages.groupBy("folder").agg(F.count("*").alias("messages"))
    holding = folders.where("holds_messages").withColumnRenamed("full_name", "folder")
    return holding.join(counts, "folder", "left").select("folder", "name", F.coalesce("messages", F.lit(0)).alias("messages"))


def running_bytes(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``folder, uid, size, running``: bytes loaded up to and including each message.

    One folder may hold a large share of all rows, so its total is not run in one task: the
    rows are summed within blocks of uids, and each block starts from the sum of those before. A folder's range of
    uids is cut into as many equal blocks as its rows need, so sparse uids make no more blocks than dense ones.
    A null folder is a folder like any other.
    """
    own = rows.select("folder", "uid", "size")
    spans = own.groupBy("folder").agg(F.min("uid").alias("low"), F.max("uid").alias("high"), F.count("*").alias("n"))
    blocks = F.least(F.ceil(F.col("n") / block_rows), F.lit(MOST_BLOCKS))
    width = F.greatest(F.ceil((F.col("high") - F.col("low") + 1) / blocks), F.lit(1))
    spans = spans.select(F.col("folder").alias("of"), "low", width.alias("width"))
    blocked = own.join(spans, own["folder"].eqNullSafe(spans["of"])).select(
        "folder", "uid", "size", F.floor((F.col("uid") - F.col("low")) / F.col("width")).alias("block")
    )
    inside = Window.partitionBy("folder", "block").orderBy("uid").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("folder").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a second read of three columns, summed before its shuffle
    sums = blocked.groupBy("folder", "block").agg(F.sum("size").alias("bytes"))
    starts = sums.select("folder", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    return (
        blocked.withColumn("part", F.sum("size").over(inside))
        .withColumnsRenamed({"folder": "own_folder", "block": "own_block"})
        .join(starts, F.col("own_folder").eqNullSafe(F.col("folder")) & F.col("own_block").eqNullSafe(F.col("block")))
        .select("folder", "uid", "size", (F.col("start") + F.col("part")).alias("running"))
    )
