"""Shards for hot keys: a key that holds a large share of all rows is spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than one row in HOT_SHARE, and at least HOT_ROWS rows. Counts sum
# to the total, so there are fewer than HOT_SHARE hot keys however large the data is; that bounds
# what is broadcast.
HOT_SHARE = 100_000
HOT_ROWS = 100_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, share: int = HOT_SHARE, least_rows: int = HOT_ROWS) -> DataFrame:
    """``keys + shards`` for the hot rows of ``counts``, which has one row per key."""
    total = counts.agg(F.sum(n).alias("total")).scalar()
    count = F.col(n)
    shards = F.least(F.ceil(count * share / total), F.ceil(count / least_rows)).cast("int")
    return counts.where((count >= least_rows) & (count * share > total)).select(*keys, shards.alias("shards"))


def with_shard(rows: DataFrame, hot: DataFrame, keys: list[str], spread_by: Column) -> DataFrame:
    """Add ``shard``: 0 for cold keys, a hash of ``spread_by`` within the key's shards for hot ones."""
    return rows.join(F.broadcast(hot), keys, "left").withColumn(
        "shard", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("shards")), F.lit(0)).cast("int")
    ).drop("shards")


def for_each_shard(one_per_key: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Repeat each row once per shard of its key, to join with rows from :func:`with_shard`."""
    return (
        one_per_key.join(F.broadcast(hot), keys, "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shards"), F.lit(1)) - 1)))
        .drop("shards")
    )
