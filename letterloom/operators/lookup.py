"""Messages laid out by hash of their key, so that a few of them are read without a scan of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.operators.search import fetch
from letterloom.session import written

PARTS = 256


def part_of(key: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def lay_out(messages: DataFrame, root: str, key: str = "path", parts: int = PARTS) -> None:
    """Write ``messages`` in ``parts`` directories; rows with a null key are in one of them like any others."""
    rows = messages.withColumn("part", part_of(F.col(key), parts))
    rows.repartition("part").sortWithinPartitions("part", key).write.mode("overwrite").partitionBy("part").parquet(root)


def laid_out(spark: SparkSession, root: str, requests: DataFrame, key: str = "path", parts: int = PARTS) -> DataFrame:
    """The messages in the directories, and row groups, that the requests' keys can lie in."""
    of = part_of(F.col(key), parts)
    # a list of at most ``parts`` numbers and two keys
    span = requests.agg(F.collect_set(of).alias("parts"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    return spark.read.parquet(root).where(F.col("part").isin(span.parts) & F.col(key).between(span.low, span.high))


def fetch_laid_out(requests: DataFrame, root: str, key: str = "path", parts: int = PARTS) -> DataFrame:
    """Requested messages with ``status`` found or missing, as :func:`search.fetch` gives them."""
    requests = written(requests, "requests")
    return fetch(requests, laid_out(requests.sparkSession, root, requests, key, parts).drop("part"), key=key)
