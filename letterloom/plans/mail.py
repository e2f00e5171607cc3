"""Mail folders end to end: build an index over message files, keep it current, show results.

Parsed messages are stored beside the index, ``messages/gen=G`` by the load that read them, so that
hits are joined to them and no file is read again for a result page. A version shows the messages
whose path and stamp its documents name, whatever generation their postings are in by now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.operators import search as s
from letterloom.operators.refresh import classify, newest
from letterloom.plans.index import Index, next_numbers, refresh_index, write_index
from letterloom.session import written
from letterloom.sources.files import listing, scan_files
from letterloom.sources.messages import MESSAGE_SCHEMA, ingest_messages, message_docs, message_texts, rejects

SUFFIX = ".eml"


def _scan(spark: SparkSession, roots, modified_since=None) -> DataFrame:
    return scan_files(spark, roots, SUFFIX, ignore_case=False, modified_since=modified_since)


def _store(messages: DataFrame, root: str, gen: int) -> DataFrame:
    path = f"{root}/messages/gen={gen}"
    messages.write.mode("overwrite").parquet(path)
    return messages.sparkSession.read.schema(MESSAGE_SCHEMA).parquet(path)


def index_mail(spark: SparkSession, roots: str | list[str], root: str, **options) -> Index:
    """Build an index at ``root`` over the message files below ``roots``."""
    messages = _store(ingest_messages(_scan(spark, roots)), root, next_numbers(spark, root)[1])
    return write_index(message_docs(messages), message_texts(messages), root, **options)


def changed_files(spark: SparkSession, roots: str | list[str], todo: DataFrame) -> DataFrame:
    """Files of the paths in ``todo``. Older files than the oldest of them are never opened."""
    oldest = todo.agg(F.timestamp_millis(F.min("stamp"))).first()[0]
    return _scan(spark, roots, modified_since=oldest).join(todo.select("path"), "path", "left_semi")


def refresh_mail(index: Index, roots: str | list[str], **options) -> Index:
    """Take in new and changed files and drop those that are gone.

    Listing reads no contents; only new and changed files are parsed. A changed file that cannot
    be parsed keeps its old entry, a new one is left out; both are in :func:`mail_rejects`.
    """
    spark = index.spark
    files = listing(_scan(spark, roots))
    todo = written(classify(files, index.docs()).where("state <> 'unchanged'"), "mail-todo")
    gen = next_numbers(spark, index.root)[1]
    current = files.withColumn("doc_id", F.col("path")).select("doc_id", "path", "id", "stamp")
    if todo.isEmpty():
        return refresh_index(index, current, lambda changed: None, **options)
    messages = _store(ingest_messages(changed_files(spark, roots, todo)), index.root, gen)
    kept = index.docs().select("path", F.col("stamp").alias("kept_stamp"))
    failed = written(rejects(messages).select("path").join(kept, "path", "left").withColumn("failed", F.lit(True)), "mail-failed")
    current = (
        current.join(failed, "path", "left")
        .where("failed is null or kept_stamp is not null")
        .withColumn("stamp", F.coalesce("kept_stamp", "stamp"))
        .drop("failed", "kept_stamp")
    )

    def texts_of(changed: DataFrame) -> DataFrame:
        return message_texts(messages).join(changed.select("doc_id"), "doc_id", "left_semi")

    return refresh_index(index, current, texts_of, **options)


def _stored(index: Index) -> DataFrame:
    return index.spark.read.schema(f"{MESSAGE_SCHEMA}, gen int").parquet(f"{index.root}/messages")


def mail_messages(index: Index, among: DataFrame | None = None) -> DataFrame:
    """The live parsed messages, with ``doc_id``; with ``among``, only those of its ``doc_id``.

    The few asked for are picked before anything is shuffled. A message that was loaded again with the same
    stamp counts as loaded last.
    """
    docs = index.docs() if among is None else index.docs().join(among.select("doc_id"), "doc_id", "left_semi")
    rows = _stored(index).where(F.col("error").isNull())
    rows = rows.join(docs.select("doc_id", "path", "stamp"), ["path", "stamp"])
    return newest(rows, "path", "gen").drop("gen")


def mail_rejects(index: Index) -> DataFrame:
    """Files whose last reading failed, with the reason."""
    rows = _stored(index).select("path", "id", "stamp", "size", "error", "gen")
    return rejects(newest(rows, "path", "gen"))


def search_mail(index: Index, clauses: DataFrame, k: int = s.TOP_K, **options) -> DataFrame:
    """Ranked results as a reader sees them: subject, sender, time sent, size and link."""
    hits = written(s.search(index, clauses, k, **options), "mail-hits")
    return s.result_view(hits, mail_messages(index, among=hits))
