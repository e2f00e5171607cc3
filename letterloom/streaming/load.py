"""Incremental load by a growing key (``uid`` per ``folder``), as a batch step and as a stream.

A stored folder holds three tables, each with one ``batch_id`` directory per micro-batch:

``messages``   the loaded rows
``marks``      per folder the highest uid of the batch
``tombstones`` folder and uid of rows that were deleted at the source
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from letterloom.operators.refresh import apply_tombstones
from letterloom.session import empty, written

KEYS = ["folder", "uid"]


def load_marks(rows: DataFrame) -> DataFrame:
    """``folder, last_uid``: the highest uid of each folder."""
    return rows.groupBy("folder").agg(F.max("uid").alias("last_uid"))


def raise_marks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Marks after a load; a mark never falls."""
    return old.unionByName(new).groupBy("folder").agg(F.max("last_uid").alias("last_uid"))


def at_or_below(source: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows that a load has passed already: uid not above the mark of their folder."""
    marked = source.join(marks, "folder", "left")
    return marked.where("uid <= last_uid").drop("last_uid")


def above(source: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows above the mark of their folder, or of a folder without one."""
    marked = source.join(marks, "folder", "left")
    return marked.where("last_uid is null or uid > last_uid").drop("last_uid")


def incremental_batch(source: DataFrame, marks: DataFrame, stored: DataFrame) -> DataFrame:
    """Source rows to load: above the folder's mark, or passed by it but not stored.

    Only the rows that were passed are looked up. The marks and the keys of those rows are
    written first: where they are few, as they are in a regular load, neither the source nor the
    stored keys are shuffled.
    """
    marks = written(marks, "marks")
    late = at_or_below(source, marks)
    late_keys = written(late.select(*KEYS), "late-keys")
    if late_keys.isEmpty():
        return above(source, marks)
    present = written(stored.select(*KEYS).join(late_keys, KEYS, "left_semi"), "present-keys")
    return above(source, marks).unionByName(late.join(present, KEYS, "left_anti"))


def without_repeats(batch: DataFrame) -> DataFrame:
    """One row per key, the first in the order of all columns, so that a replay stores the same one. Rows whose
    key comes once, as nearly all do, are not shuffled."""
    repeated = written(batch.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1").select(*KEYS), "repeated-keys")
    if repeated.isEmpty():
        return batch
    once = batch.join(repeated, KEYS, "left_anti")
    rest = [c for c in batch.columns if c not in KEYS]
    first = batch.join(repeated, KEYS, "left_semi").groupBy(*KEYS).agg(F.min(F.struct(*rest)).alias("first"))
    return once.unionByName(first.select(*KEYS, "first.*"))


def above_mark(source: DataFrame, last_uid: int) -> DataFrame:
    """Rows of one folder above its mark; the comparison is pushed into the scan."""
    return source.where(F.col("uid") > last_uid)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)  # told, not inferred from all that is stored
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, schema)


def stored_marks(spark: SparkSession, root: str) -> DataFrame:
    rows = _read(spark, f"{root}/marks", "folder string, last_uid bigint, batch_id bigint")
    return rows.groupBy("folder").agg(F.max("last_uid").alias("last_uid"))


def write_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Store one micro-batch. Running it again replaces the same directories with the same rows.

    Rows of the batch's own id are left out of every comparison, or a replay would find its
    first attempt stored and replace it with nothing.
    """
    spark = batch.sparkSession
    if "expunged" not in batch.columns:
        batch = batch.withColumn("expunged", F.lit(False))
    dead = batch.where("expunged").select(*KEYS).distinct()
    dead.write.mode("overwrite").parquet(f"{root}/tombstones/batch_id={batch_id}")

    other = F.col("batch_id") != batch_id
    marks = _read(spark, f"{root}/marks", "folder string, last_uid bigint, batch_id bigint").where(other)
    marks = marks.groupBy("folder").agg(F.max("last_uid").alias("last_uid"))
    stored = _read(spark, f"{root}/messages", "folder string, uid bigint, batch_id bigint").where(other)
    alive = without_repeats(batch.where(~F.col("expunged")).drop("expunged"))
    path = f"{root}/messages/batch_id={batch_id}"
    incremental_batch(alive, marks, stored).write.mode("overwrite").parquet(path)
    written = load_marks(spark.read.schema(alive.schema).parquet(path))
    written.coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/batch_id={batch_id}")


def incremental_load(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Start loading everything that arrived since the last run; stops when it is caught up."""
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def loaded(spark: SparkSession, root: str) -> DataFrame:
    """The stored rows without those deleted at the source, whichever came first."""
    messages = spark.read.parquet(f"{root}/messages")
    tombstones = _read(spark, f"{root}/tombstones", "folder string, uid bigint")
    return apply_tombstones(messages, tombstones, KEYS)


def once_only_load(stream: DataFrame, root: str, checkpoint: str, time: str = "at", delay: str = "1 day") -> StreamingQuery:
    """Append each key (folder and uid) once, however often it is delivered within ``delay`` of event time.

    Keys seen are the query's own state, kept in its checkpoint until the watermark has passed them, so nothing that is stored is read
    again and a restart goes on where the last run ended. Rows older than the watermark are late and dropped by it.
    """
    rows = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(KEYS)
    return (
        rows.writeStream.format("parquet")
        .option("path", root)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
