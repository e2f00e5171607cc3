"""Index statistics: what each document holds per term, and how often each term occurs.

Input is a *texts* frame ``doc_id, field, values array<string>``: one row per document and field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.functions.text import POSITION_GAP, spaced_tokens, term_entries


def forward_index(texts: DataFrame, stop_words=(), gap: int = POSITION_GAP) -> DataFrame:
    """``doc_id, field, len, entries array<struct<term, pos>>``: a projection, without a shuffle."""
    entries = term_entries(spaced_tokens(F.col("values"), gap), stop_words)
    return texts.select("doc_id", "field", entries.alias("entries")).select(
        "doc_id",
        "field",
        F.aggregate("entries", F.lit(0), lambda n, e: n + F.size(e["pos"])).alias("len"),
        "entries",
    )


def _exploded(forward: DataFrame, entries: str, *keep: str) -> DataFrame:
    # explode() would add a filter on the array's size, push it to the scan and so tokenise
    # every text twice more there; the outer form adds none, and empty documents go after it
    return forward.select(*keep, F.explode_outer(entries).alias("e")).where("e is not null")


def postings(forward: DataFrame) -> DataFrame:
    """``field, term, doc_id, tf, pos, len``; ``len`` repeats the document's field length, so
    that scoring needs no join to look it up."""
    keep = [c for c in forward.columns if c != "entries"]
    return _exploded(forward, "entries", *keep).select(
        "field",
        F.col("e.term").alias("term"),
        *[c for c in keep if c not in ("field", "len")],
        F.size("e.pos").alias("tf"),
        F.col("e.pos").alias("pos"),
        "len",
    )


def term_counts(forward: DataFrame) -> DataFrame:
    """``field, term, df``: number of documents per term, combined before the shuffle."""
    terms = _exploded(forward, "entries.term", "field").withColumnRenamed("e", "term")
    return terms.groupBy("field", "term").agg(F.count("*").alias("df"))


def doc_lengths(forward: DataFrame) -> DataFrame:
    """``field, doc_id, len``."""
    return forward.select("field", "doc_id", "len")
