"""Registered queries: each operator over the whole driver tables.

``documents`` stand for message bodies (``source`` is the folder), ``benchmark`` texts are the
query batch, ``events`` the load stream, ``pages`` HTML bodies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions.bytes import format_bytes
from letterloom.functions.text import ENGLISH_STOP_WORDS, tokens
from letterloom.operators import search as s
from letterloom.operators.dupes import dup_groups, dup_members, staged_members
from letterloom.operators.lookup import fetch_laid_out, lay_out
from letterloom.operators.postings import doc_lengths, forward_index, postings, term_counts
from letterloom.operators.refresh import apply_tombstones, classify, newest, stale, upsert
from letterloom.operators.report import folder_counts, load_report, running_bytes
from letterloom.plans.index import Index, compact_index, has_index, open_index, refresh_index, write_index
from letterloom.session import new_folder, own_folder, written
from letterloom.sources.files import scan_files, write_files
from letterloom.sources.messages import header_lines, ingest_messages, message_texts
from letterloom.sources.pages import page_text
from letterloom.streaming.load import above_mark, incremental_batch, incremental_load, load_marks, loaded, once_only_load

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents as messages -------------------------------------------------------------------


def _path() -> Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".eml"))


def document_listing(documents: DataFrame) -> DataFrame:
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".eml"))
    return documents.select("doc_id", _path().alias("path"), name.alias("id"), F.col("doc_id").alias("stamp"))


def document_texts(documents: DataFrame) -> DataFrame:
    fields = F.array(
        F.struct(F.lit("body").alias("field"), F.array("text").alias("values")),
        F.struct(F.lit("source").alias("field"), F.array("source").alias("values")),
    )
    rows = documents.select("doc_id", "text", "source")
    return rows.select("doc_id", F.explode(fields).alias("f")).select("doc_id", "f.field", "f.values")


def body_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return forward_index(documents.select("doc_id", F.lit("body").alias("field"), F.array("text").alias("values")))


def documents_index(spark: SparkSession, sf_dir: str, stop_words=()) -> Index:
    """The index over ``documents``, built on first use in an application and reopened after.

    Its name holds what the table's files are (path, length, time), so a table that changed is indexed anew.
    """
    documents = table(spark, sf_dir, "documents")
    files = documents.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    name = hashlib.md5(repr((sf_dir, tuple(state), tuple(stop_words))).encode()).hexdigest()[:12]
    root = f"{own_folder(spark)}/documents-{name}"
    if has_index(spark, root):
        return open_index(spark, root)
    return write_index(document_listing(documents), document_texts(documents), root, stop_words=stop_words)


def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- duplicates ------------------------------------------------------------------------------


def dupes_md5(spark, sf_dir):
    return dup_groups(table(spark, sf_dir, "documents"), "doc_id", content="text", algorithm="md5")


def dupes_members(spark, sf_dir):
    return dup_members(table(spark, sf_dir, "documents"), "doc_id", content="text", algorithm="md5")


def dupes_verified(spark, sf_dir):
    rows = dup_members(table(spark, sf_dir, "documents"), "doc_id", content="text", algorithm="md5", verify=True)
    return rows.select("hash", F.col("bytes").cast("bigint").alias("bytes"), "digest", "doc_id", "n", "first_key")


def _dupes_by(algorithm: str) -> Query:
    def query(spark, sf_dir):
        rows = dup_members(table(spark, sf_dir, "documents"), "doc_id", content="text", algorithm=algorithm)
        return rows.select("doc_id", "n", "first_key")

    return query


def dupes_prefix(spark, sf_dir):
    """Documents that share their first 64 bytes, whatever follows."""
    documents = table(spark, sf_dir, "documents")
    rows = dup_members(documents, "doc_id", content="text", algorithm="md5", prefix_bytes=64, verify=False)
    return rows.select("doc_id", "n", "first_key")


def dupes_staged(spark, sf_dir):
    """Equal documents: by length first, then by their first 64 bytes, then whole."""
    documents = table(spark, sf_dir, "documents")

    def contents_of(rows: DataFrame) -> DataFrame:
        return documents.select("doc_id", F.col("text").alias("content")).join(rows, "doc_id", "left_semi")

    listing = documents.select("doc_id", F.col("n_chars").alias("size"))
    return staged_members(listing, contents_of, "doc_id", prefix_bytes=64).select("doc_id", "n", "first_key")


# --- index statistics ------------------------------------------------------------------------


def postings_query(spark, sf_dir):
    rows = postings(body_forward(spark, sf_dir))
    return rows.select("term", "doc_id", "tf", F.get("pos", 0).alias("first_pos"), F.element_at("pos", -1).alias("last_pos"))


def term_df(spark, sf_dir):
    return term_counts(body_forward(spark, sf_dir)).select("term", "df")


def doc_len(spark, sf_dir):
    return doc_lengths(body_forward(spark, sf_dir)).select("doc_id", "len")


# --- search ----------------------------------------------------------------------------------


def _search_terms(clauses: Callable[[DataFrame], DataFrame], kinds=("term",), occurs=("should",), stop_words=()) -> Query:
    def query(spark, sf_dir):
        index = documents_index(spark, sf_dir, stop_words)
        return s.search(index, clauses(query_batch(spark, sf_dir)), kinds=kinds, occurs=occurs)

    return query


def words_clauses(batch: DataFrame) -> DataFrame:
    return s.query_words(batch, field="body")


def must_clauses(batch: DataFrame) -> DataFrame:
    return s.query_words(batch, field="body", occur="must")


def not_clauses(batch: DataFrame) -> DataFrame:
    """All words of a text, of which its first in the alphabet must not occur."""
    first = batch.select("query_id", F.array_min(tokens(F.col("text"))).alias("first"))
    rows = s.query_words(batch, field="body").join(first, "query_id")
    occur = F.when(F.col("term") == F.col("first"), "must_not").otherwise("should")
    return rows.withColumn("occur", occur).drop("first")


def field_clauses(batch: DataFrame) -> DataFrame:
    """The words of a text, in documents of the folder with the text's number."""
    folder = batch.select("query_id", F.concat(F.lit("src"), F.col("query_id").cast("string")).alias("term"))
    folder = folder.withColumn("clause_id", F.lit(-1))
    return s.query_words(batch, field="body").unionByName(s.as_clauses(folder, field="source", occur="must"))


def boost_clauses(batch: DataFrame) -> DataFrame:
    return s.query_words(batch, field="body").withColumn("boost", F.when(F.length("term") > 4, 3.0).otherwise(1.0))


def passage_clauses(batch: DataFrame) -> DataFrame:
    """Each text as one phrase."""
    return s.as_clauses(batch.select("query_id", F.col("text").alias("term")), kind="phrase", field="body")


def pair_clauses(batch: DataFrame) -> DataFrame:
    """Each pair of neighbouring words of a text as a phrase with slop 2."""
    words = batch.select("query_id", tokens(F.col("text")).alias("w"))
    pairs = words.select("query_id", "w", F.posexplode("w").alias("clause_id", "a")).withColumn("b", F.get("w", F.col("clause_id") + 1))
    pairs = pairs.where("b is not null").select("query_id", "clause_id", F.concat("a", F.lit(" "), "b").alias("term"))
    return s.as_clauses(pairs, kind="phrase", field="body", slop=2)


def each_word(kind: str, term: Column | None = None, slop: int = 0) -> Callable[[DataFrame], DataFrame]:
    """A clause for every word of a text, made from the word (column ``term``)."""

    def clauses(batch: DataFrame) -> DataFrame:
        rows = s.query_words(batch, field="body").withColumns({"kind": F.lit(kind), "slop": F.lit(slop)})
        return rows if term is None else rows.withColumn("term", term)

    return clauses


def range_clauses(batch: DataFrame) -> DataFrame:
    """From each word up to its first two letters followed by z."""
    return each_word("range")(batch).withColumn("upper", F.concat(F.left("term", F.lit(2)), F.lit("z")))


def _start() -> Column:
    return F.left("term", F.lit(4))


def _wildcard() -> Column:
    return F.concat(F.left("term", F.lit(2)), F.lit("?*"), F.right("term", F.lit(2)))


def _regexp() -> Column:
    return F.concat(F.left("term", F.lit(2)), F.lit("[a-m]+"), F.right("term", F.lit(1)), F.lit("?"))


def search_rejected(spark, sf_dir):
    """Expressions of which two in three are wrong, by the place of their word: what is reported of them."""
    place = F.col("clause_id") % 3
    wrong = F.when(place == 0, F.concat("term", F.lit("("))).when(place == 1, F.concat(F.lit("*"), F.col("term"))).otherwise(F.col("term"))
    clauses = each_word("regexp")(query_batch(spark, sf_dir)).withColumn("term", wrong)
    return s.rejected_clauses(clauses).select("query_id", F.col("clause_id").cast("long").alias("clause_id"), "term", "reason")


def exact_clauses(batch: DataFrame) -> DataFrame:
    """The document with the text's number by its id, and by its path in a folder where it may not be."""
    own = F.col("query_id").cast("string")
    name = batch.select("query_id", F.concat(own, F.lit(".eml")).alias("term"))
    folder = F.concat(F.lit("src"), (F.col("query_id") % 15).cast("string"), F.lit("/"))
    path = batch.select("query_id", F.concat(folder, own, F.lit(".eml")).alias("term"))
    return s.as_clauses(name, kind="exact", field="id").unionByName(s.as_clauses(path, kind="exact", field="path", boost=2.0, clause_id=1))


def search_blank(spark, sf_dir):
    """The word search when every third text is blank."""
    blank = F.when(F.col("query_id") % 3 == 0, F.lit(" \t ")).otherwise(F.col("text"))
    batch = query_batch(spark, sf_dir).withColumn("text", blank)
    return s.search(documents_index(spark, sf_dir), words_clauses(batch), kinds=("term",), occurs=("should",))


def _sent() -> Column:
    """An hour later for each document."""
    return F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)


def _subject() -> Column:
    return F.when(F.col("lang") != "fr", F.col("lang"))


def search_results(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    messages = documents.select(
        "doc_id",
        _subject().alias("subject"),
        F.array("source", "lang").alias("from"),
        _sent().alias("sent"),
        F.col("n_chars").alias("size"),
        _path().alias("path"),
    )
    hits = _search_terms(words_clauses)(spark, sf_dir)
    return s.result_view(hits, messages).withColumn("size_text", format_bytes(F.col("size")))


def fetch_by_key(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"))
    return s.fetch(requests, table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), key="doc_id")


def fetch_few(spark, sf_dir):
    """A few documents, some of which there are not, out of a table that is laid out by their keys."""
    root = new_folder(spark, "laid-out")
    lay_out(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), root, "doc_id", parts=32)
    requests = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7 - 20).alias("doc_id"))
    return fetch_laid_out(requests, root, "doc_id", parts=32)


def search_all_docs(spark, sf_dir):
    """Every document that shares no word with the query batch."""
    index = documents_index(spark, sf_dir)
    words = query_batch(spark, sf_dir).withColumn("query_id", F.lit(0))
    words = words.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).distinct()
    met = s.scored(s.clause_hits(index, s.as_clauses(words, field="body"), kinds=("term",), occurs=("should",)))
    return s.none_of(s.match_all(index), met).select("doc_id", "score")


def search_nested(spark, sf_dir):
    """(any word of the text) and (any of them misspelt by one letter)."""
    index = documents_index(spark, sf_dir)
    batch = query_batch(spark, sf_dir)
    words = s.scored(s.clause_hits(index, words_clauses(batch), ("term",), ("should",)))
    near = s.scored(s.clause_hits(index, each_word("fuzzy", slop=1)(batch), ("fuzzy",), ("should",)))
    return s.all_of(words, near).select("query_id", "doc_id", F.round("score", 6).alias("score"))


# --- refresh ---------------------------------------------------------------------------------


def old_listing(spark, sf_dir):
    """Before folder src7 arrived."""
    return document_listing(table(spark, sf_dir, "documents").where("source <> 'src7'"))


def new_listing(spark, sf_dir):
    """After folder src3 was deleted and the documents labelled toxic were edited."""
    edited = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = document_listing(table(spark, sf_dir, "documents").where("source <> 'src3'")).join(edited, "doc_id", "left")
    return rows.withColumn("stamp", F.col("stamp") + F.coalesce("toxic", F.lit(0))).drop("toxic")


def refresh_classify(spark, sf_dir):
    return classify(new_listing(spark, sf_dir), old_listing(spark, sf_dir)).select("path", "state")


def refresh_upsert(spark, sf_dir):
    old = old_listing(spark, sf_dir)
    fresh = classify(new_listing(spark, sf_dir), old).where("state <> 'unchanged'").drop("state")
    return upsert(old, fresh).select("path", "stamp")


def refresh_stale(spark, sf_dir):
    return stale(old_listing(spark, sf_dir), new_listing(spark, sf_dir)).select("path")


def refresh_terms(spark, sf_dir):
    """Term counts of an index of the old listing after it was refreshed to the new one."""
    documents = table(spark, sf_dir, "documents")
    old = old_listing(spark, sf_dir)
    texts = document_texts(documents.where("source <> 'src7'"))
    index = write_index(old, texts, new_folder(spark, "refresh-index"), stop_words=())

    def texts_of(changed: DataFrame) -> DataFrame:
        return document_texts(documents).join(changed.select("doc_id"), "doc_id", "left_semi")

    index = refresh_index(index, new_listing(spark, sf_dir), texts_of)
    return index.terms().select("field", "term", "df")


def refresh_compact_search(spark, sf_dir):
    """The word search in an index that was refreshed to the new listing and then compacted."""
    documents = table(spark, sf_dir, "documents")
    texts = document_texts(documents.where("source <> 'src7'"))
    index = write_index(old_listing(spark, sf_dir), texts, new_folder(spark, "refresh-index"), stop_words=())

    def texts_of(changed: DataFrame) -> DataFrame:
        return document_texts(documents).join(changed.select("doc_id"), "doc_id", "left_semi")

    index = compact_index(refresh_index(index, new_listing(spark, sf_dir), texts_of))
    return s.search(index, words_clauses(query_batch(spark, sf_dir)), kinds=("term",), occurs=("should",))


def newest_version(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", _micros(F.col("ts")).alias("stamp"))
    return newest(rows, "user_id", "stamp", "event_id").select("user_id", "event_id", "event_type")


def _micros(ts: Column) -> Column:
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, ts.cast("timestamp_ntz"))


# --- load ------------------------------------------------------------------------------------


def event_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("folder"), F.col("event_id").alias("uid"), F.col("value").alias("size"), _micros(F.col("ts")).alias("us")
    )


def _middle(rows: DataFrame) -> Column:
    return rows.agg(F.expr("(min(us) + max(us)) div 2").alias("middle")).scalar()


def incremental_batch_query(spark, sf_dir):
    """What a load fetches when the first half of the time is stored, but for files above 200 bytes that were lost."""
    rows = event_rows(spark, sf_dir)
    earlier = rows.where(F.col("us") <= _middle(rows))
    return incremental_batch(rows, load_marks(earlier), earlier.where("size <= 200")).select("folder", "uid", "size")


def load_mark(spark, sf_dir):
    return load_marks(event_rows(spark, sf_dir))


def load_running(spark, sf_dir):
    return running_bytes(event_rows(spark, sf_dir)).select("folder", "uid", F.round("running", 2).alias("running"))


def tombstones(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    dead = events.where("event_type = 'error'").select("event_id")
    return apply_tombstones(events, dead, "event_id").select("event_id", "event_type", "value")


def load_stream(spark, sf_dir):
    """Two drops and three runs. The second drop brings purchases of the first half again and
    deletes errors of the first half."""
    rows = event_rows(spark, sf_dir)
    rows = rows.withColumn("early", F.col("us") <= _middle(rows))
    root = new_folder(spark, "load")
    first = rows.where("early").withColumn("expunged", F.lit(False))
    again = first.where("folder = 'purchase'")
    dead = first.where("folder = 'error'").withColumn("expunged", F.lit(True))
    second = rows.where("not early").withColumn("expunged", F.lit(False)).unionByName(again).unionByName(dead)
    schema = first.drop("early").schema

    def run() -> None:
        stream = spark.readStream.schema(schema).parquet(f"{root}/drops/*")
        query = incremental_load(stream, f"{root}/stored", f"{root}/checkpoint")
        query.awaitTermination()

    first.drop("early").write.parquet(f"{root}/drops/1")
    run()
    second.drop("early").write.parquet(f"{root}/drops/2")
    run()
    run()
    return loaded(spark, f"{root}/stored").select("folder", "uid", "size")


def load_once(spark, sf_dir):
    """Two drops and three runs; the second drop brings again what came in the last quarter before the middle."""
    rows = event_rows(spark, sf_dir).withColumn("at", F.timestamp_micros("us"))
    span = rows.agg(F.min("us").alias("low"), F.max("us").alias("high")).first()
    middle, quarter = (span.low + span.high) // 2, (span.high - span.low) // 4
    root = new_folder(spark, "once")
    early = rows.where(F.col("us") <= middle)
    again = early.where(F.col("us") > middle - quarter)

    def run() -> None:
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/drops/*")
        once_only_load(stream, f"{root}/stored", f"{root}/checkpoint", delay=f"{2 * quarter // 1_000_000 + 1} seconds").awaitTermination()

    early.write.parquet(f"{root}/drops/1")
    run()
    rows.where(F.col("us") > middle).unionByName(again).write.parquet(f"{root}/drops/2")
    run()
    run()
    return spark.read.schema(rows.schema).parquet(f"{root}/stored").select("folder", "uid", "size")


def above_mark_query(spark, sf_dir):
    """Purchases above the last one of the first half of the time."""
    rows = event_rows(spark, sf_dir).where("folder = 'purchase'")
    last = rows.where(F.col("us") <= _middle(event_rows(spark, sf_dir))).agg(F.max("uid")).first()[0]
    return above_mark(rows, last).select("folder", "uid", "size")


def folder_counts_query(spark, sf_dir):
    """Documents per folder; folder src2 has lost its own, and src1 holds other folders only."""
    documents = table(spark, sf_dir, "documents").withColumnRenamed("source", "folder")
    folders = documents.select(F.col("folder").alias("full_name"), F.upper("folder").alias("name")).distinct()
    return folder_counts(folders.withColumn("holds_messages", F.col("full_name") != "src1"), documents.where("folder <> 'src2'"))


def load_report_query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return load_report(documents.select(F.col("source").alias("folder"), F.col("n_chars").alias("size")))


def format_sizes(spark, sf_dir):
    size = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        "doc_id", format_bytes(size).alias("binary_size"), format_bytes(size, si=True).alias("si_size")
    )


# --- pages and messages ----------------------------------------------------------------------


def page_text_query(spark, sf_dir):
    return page_text(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")


def _file(content: Column, key: Column) -> list[Column]:
    return [
        F.concat(F.lit("mail/"), key.cast("string"), F.lit(".eml")).alias("path"),
        F.timestamp_seconds(F.lit(1704067200)).alias("modificationTime"),
        F.length(content).cast("bigint").alias("length"),
        content.alias("content"),
    ]


def message_ingest(spark, sf_dir):
    """Documents written as plain messages and parsed back."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mail = F.concat(
        F.lit("From: "), "source", F.lit("@example.org\r\nSubject: "), "lang",
        F.lit("\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"), "text",
    )
    messages = ingest_messages(documents.select(*_file(F.encode(mail, "UTF-8"), F.col("doc_id"))))
    part = F.get("parts", 0)
    return messages.select(
        "id", "subject", F.array_join("from", "; ").alias("sender"), part["content_type"].alias("content_type"), part["text"].alias("body"), "error"
    )


def mail_files(spark, sf_dir):
    """Documents as one message file each, found again below overlapping and missing folders, as a reader sees them."""
    root = new_folder(spark, "files")
    documents = table(spark, sf_dir, "documents")
    subject = F.coalesce(F.concat(F.lit("Subject: "), _subject(), F.lit("\n")), F.lit(""))
    kind = F.when(F.col("doc_id") % 2 == 0, "TEXT/Plain").otherwise("text/plain")
    mail = F.concat(
        F.lit("From: The "), "source", F.lit(" <"), "source", F.lit("@example.org>\n"), subject,
        F.lit("Date: "), F.date_format(_sent(), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000\nContent-Type: "), kind,
        F.lit("; charset=utf-8\n\n"), "text",
    )
    write_files(documents.select("source", "doc_id", mail.alias("value")), f"{root}/mail", "source", "doc_id")
    files = scan_files(spark, [f"{root}/mail", f"{root}/mail/source=src1", f"{root}/absent"], ".TXT")
    # each file is opened and cut once, whatever is asked of the messages
    messages = written(ingest_messages(files), "messages")
    number = F.regexp_extract("path", "/doc_id=([0-9]+)[/.]", 1).cast("bigint")
    texts = message_texts(messages, per_part=False).where("field = 'body_all'")
    texts = texts.select(F.col("doc_id").alias("path"), F.get("values", 0).alias("body"))
    hits = messages.select("path", number.alias("doc_id"), F.lit(0).alias("query_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    shown = s.result_view(hits.drop("path"), messages.withColumn("doc_id", number))
    shown = shown.join(hits.select("doc_id", "path").join(texts, "path"), "doc_id")
    return shown.select("doc_id", "subject", "sender", "sent", "size", F.regexp_replace("body", r"\n$", "").alias("body"))


def html_body(spark, sf_dir):
    """Pages written as messages of a plain and an HTML part: the fields that are indexed."""
    pages = table(spark, sf_dir, "pages")
    cut = "\r\n--=_part\r\n"
    mail = F.concat(
        F.lit('Subject: page\r\nContent-Type: multipart/mixed; boundary="=_part"\r\n' + cut),
        F.lit("Content-Type: text/plain; charset=utf-8\r\n\r\n"), "url", F.lit(cut),
        F.lit("Content-Type: text/html; charset=utf-8\r\n\r\n"), "html", F.lit("\r\n--=_part--\r\n"),
    )
    messages = ingest_messages(pages.select(*_file(F.encode(mail, "UTF-8"), F.col("page_id"))))
    return message_texts(messages).select(F.col("doc_id").alias("path"), "field", F.array_join("values", "|").alias("value"))


def header_lines_query(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    header = F.array(F.struct(F.col("role").alias("name"), F.col("text").alias("value")))
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return header_lines(rows.select(path.alias("path"), header.alias("headers")))


QUERIES: dict[str, Query] = {
    "dupes_md5": dupes_md5,
    "dupes_members": dupes_members,
    "dupes_verified": dupes_verified,
    "dupes_prefix": dupes_prefix,
    "dupes_staged": dupes_staged,
    "dupes_crc32": _dupes_by("crc32"),
    "dupes_adler32": _dupes_by("adler32"),
    "dupes_fast64": _dupes_by("fast64"),
    "postings": postings_query,
    "term_df": term_df,
    "doc_len": doc_len,
    "search_any": _search_terms(words_clauses),
    "search_all": _search_terms(must_clauses, occurs=("must",)),
    "search_not": _search_terms(not_clauses, occurs=("should", "must_not")),
    "search_field": _search_terms(field_clauses, occurs=("should", "must")),
    "search_boost": _search_terms(boost_clauses),
    "search_phrase": _search_terms(passage_clauses, kinds=("phrase",)),
    "search_any_stop": _search_terms(words_clauses, stop_words=ENGLISH_STOP_WORDS),
    "search_all_stop": _search_terms(must_clauses, occurs=("must",), stop_words=ENGLISH_STOP_WORDS),
    "search_phrase_stop": _search_terms(passage_clauses, kinds=("phrase",), stop_words=ENGLISH_STOP_WORDS),
    "search_phrase_slop": _search_terms(pair_clauses, kinds=("phrase",)),
    "search_prefix": lambda sp, d: _search_terms(each_word("prefix", _start()), ("prefix",))(sp, d),
    "search_wildcard": lambda sp, d: _search_terms(each_word("wildcard", _wildcard()), ("wildcard",))(sp, d),
    "search_regex": lambda sp, d: _search_terms(each_word("regexp", _regexp()), ("regexp",))(sp, d),
    "search_fuzzy": _search_terms(each_word("fuzzy", slop=2), ("fuzzy",)),
    "search_range": _search_terms(range_clauses, kinds=("range",)),
    "search_rejected": search_rejected,
    "search_exact": _search_terms(exact_clauses, kinds=("exact",)),
    "search_blank": search_blank,
    "search_all_docs": search_all_docs,
    "search_nested": search_nested,
    "search_results": search_results,
    "fetch_by_key": fetch_by_key,
    "fetch_few": fetch_few,
    "refresh_classify": refresh_classify,
    "refresh_upsert": refresh_upsert,
    "refresh_stale": refresh_stale,
    "refresh_terms": refresh_terms,
    "refresh_compact_search": refresh_compact_search,
    "newest_version": newest_version,
    "incremental_batch": incremental_batch_query,
    "load_mark": load_mark,
    "load_running": load_running,
    "tombstones": tombstones,
    "load_stream": load_stream,
    "load_once": load_once,
    "load_report": load_report_query,
    "above_mark": above_mark_query,
    "folder_counts": folder_counts_query,
    "format_sizes": format_sizes,
    "page_text": page_text_query,
    "message_ingest": message_ingest,
    "mail_files": mail_files,
    "html_body": html_body,
    "header_lines": header_lines_query,
}
