"""Batch search over a stored index: many queries at once, each a set of typed clauses.

A clause is one row: ``query_id, clause_id, occur, kind, field, term, upper, slop, boost, times``.

======== ==========================================================================
kind     ``term`` holds
======== ==========================================================================
term     one word
phrase   words that follow each other; ``slop`` allows gaps and swaps
prefix   the first letters of a word
wildcard a word with ``*`` and ``?``
regexp   a regular expression for the whole word
fuzzy    a word that may differ by ``slop`` letters (0 to 2)
range    the first word of a range that ends with ``upper``; null leaves an end open
exact    a whole ``id`` or ``path`` (the field), as it is written
======== ==========================================================================

``occur`` is should, must or must_not. ``times`` counts how often a clause was given.
``clause_id`` must differ between the clauses of one query. Words and phrases are cut as the index
cut its texts: its stop words ask for nothing and count nowhere. A query with a clause that cannot be read
gives no results; :func:`rejected_clauses` tells why. Defining a search runs Spark jobs: its words are looked up and written
before the frame is returned.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions import together
from letterloom.functions.text import bind, term_entries, tokens
from letterloom.operators.dictionary import Dictionary, shelf_of
from letterloom.operators.expand import EXPANDED_KINDS, SPAN_KINDS, expand, segments, with_reasons
from letterloom.plans.index import Index, bucket_of
from letterloom.session import written
from letterloom.sources.messages import DEFAULT_FIELD

# what is done with a document's words travels with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(together)

KINDS = ("term", "phrase", "exact", *EXPANDED_KINDS)
EXACT_FIELDS = ("id", "path")
OCCURS = ("should", "must", "must_not")
TOP_K = 25

# Words of a batch are broadcast if they take no more bytes, with WORD_BYTES for the other columns of each.
BROADCAST_BYTES = 64 << 20
WORD_BYTES = 120
# Postings are dealt by document to tasks of about so many documents times clauses, and multiplied by the clauses there.
MATCHES_PER_TASK = 16_000_000
MAX_TASKS = 20_000
# Phrases of two words are counted by the words that stand so many places from each other at most, longer ones and wider ones by all places.
NEAR = 64


def as_clauses(
    rows: DataFrame,
    kind: str = "term",
    occur: str = "should",
    field: str = DEFAULT_FIELD,
    slop: int = 0,
    boost: float = 1.0,
    clause_id: int = 0,
) -> DataFrame:
    """Complete ``query_id, term`` rows (and whatever else they hold) to clauses."""
    defaults = {
        "clause_id": F.lit(clause_id),
        "occur": F.lit(occur),
        "kind": F.lit(kind),
        "field": F.lit(field),
        "upper": F.lit(None).cast("string"),
        "slop": F.lit(slop),
        "boost": F.lit(float(boost)),
        "times": F.lit(1),
    }
    columns = [F.col(n) if n in rows.columns else c.alias(n) for n, c in defaults.items()]
    return rows.select("query_id", "term", *columns)


def query_words(queries: DataFrame, occur: str = "should", field: str = DEFAULT_FIELD, boost: float = 1.0) -> DataFrame:
    """One term clause per distinct word of ``queries (query_id, text)``; blank texts give none.

    The clause id is the position of the word's first use.
    """
    words = queries.where(F.length(F.trim("text")) > 0).select(
        "query_id", F.explode_outer(term_entries(tokens(F.col("text")))).alias("word")
    )
    clauses = words.where("word is not null").select(
        "query_id",
        F.col("word.term").alias("term"),
        F.get("word.pos", 0).alias("clause_id"),
        F.size("word.pos").alias("times"),
    )
    return as_clauses(clauses, occur=occur, field=field, boost=boost)


def without_stop_words(clauses: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    """Clauses as the index would cut them: words, and phrases of words, that it never holds ask for nothing."""
    if not stop_words:
        return clauses
    word = (F.col("kind") == "term") & F.lower("term").isin(*stop_words)
    kept = F.filter(tokens(F.col("term")), lambda t: ~t.isin(*stop_words))
    return clauses.where(~word & ((F.col("kind") != "phrase") | (F.size(kept) > 0)))


def _with_totals(clauses: DataFrame) -> DataFrame:
    """Clauses with flags, and per query how many it requires and how many can score.

    Written out, so that Spark knows their size when it joins them with the dictionary.
    """
    scoring = F.col("occur") != "must_not"
    flagged = clauses.select(
        "*",
        (F.col("occur") == "must").cast("int").alias("must"),
        (~scoring).cast("int").alias("prohibited"),
        F.when(scoring, F.col("times")).otherwise(0).alias("counted"),
    )
    totals = flagged.groupBy("query_id").agg(
        F.sum("must").cast("int").alias("n_must"), F.sum("counted").cast("int").alias("n_scoring")
    )
    return written(flagged.drop("occur", "times").join(totals, "query_id"), "clauses")


def _single_terms(clauses: DataFrame) -> DataFrame:
    return clauses.where("kind = 'term'").withColumn("term", F.lower("term"))


def _phrase_terms(clauses: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    """The words of each phrase with their places; stop words leave a gap."""
    placed = F.transform(tokens(F.col("term")), lambda t, i: F.struct(i.alias("i"), t.alias("term")))
    words = F.filter(placed, lambda p: ~p["term"].isin(*stop_words)) if stop_words else placed
    rest = [c for c in clauses.columns if c != "term"]
    return clauses.where("kind = 'phrase'").select(*rest, F.size(words).alias("n_terms"), F.inline(words))


def _look_up(words: DataFrame, index: Index) -> DataFrame:
    """Add ``df`` of each word; words that no document holds drop out."""
    keyed = words.withColumn("bucket", bucket_of(index.buckets, F.col("field"), F.col("term")))
    return keyed.join(index.terms(), ["bucket", "field", "term"])


def _idf(index: Index) -> Column:
    return 1 + F.log(F.lit(float(index.n_docs)) / (F.col("df") + 1))


def _meet(words: DataFrame, index: Index, *columns: str) -> DataFrame:
    """Join written words to their postings.

    Only the buckets of the batch's words are read, and in them the row groups between its
    first and last word. A batch of up to BROADCAST_BYTES is broadcast. A larger one is
    shuffled with the postings, by slice too, so that a hot word does not land in one task.
    """
    # one row with at most index.buckets numbers; no words, no buckets, no rows
    size = F.sum(_word_bytes())
    span = words.agg(
        F.coalesce(size, F.lit(0)).alias("bytes"), F.collect_set("bucket").alias("buckets"), F.min("term").alias("low"), F.max("term").alias("high")
    ).first()
    keys = ["bucket", "field", "term"]
    rows = index.raw_postings().where(F.col("bucket").isin(span.buckets) & F.col("term").between(span.low, span.high))
    if span.bytes <= BROADCAST_BYTES:
        met = F.broadcast(words).join(rows.select(*keys, "doc_id", "gen", *columns), keys)
    else:
        sliced = words.join(F.broadcast(index.slices()), "bucket")  # one row per bucket
        sliced = sliced.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        met = sliced.join(rows.select(*keys, "slice", "doc_id", "gen", *columns), [*keys, "slice"]).drop("slice")
    return index.live(met).drop("bucket", "gen")


def _word_bytes() -> Column:
    return F.octet_length("term") + F.octet_length("field") + WORD_BYTES


def _small(rows: DataFrame, size: int) -> DataFrame:
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def _tasks(index: Index, clauses: DataFrame) -> int:
    return min(MAX_TASKS, max(-(-index.n_docs * clauses.count() // MATCHES_PER_TASK), index.spark.sparkContext.defaultParallelism))


def _by_document(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt by document. What they are multiplied to stays in its task, and groups of a document need no other shuffle, in
    a union of rows dealt alike either. The number of tasks is fixed, as Spark would judge by the bytes before."""
    return rows.repartition(tasks, "doc_id")


_QUERY_FLAGS = ["must", "prohibited", "counted", "n_must", "n_scoring"]
_HIT = ["query_id", "clause_id", "doc_id", "constant", *_QUERY_FLAGS, "weight"]


def _weighted(words: DataFrame, index: Index) -> DataFrame:
    """Words with ``base``, the part of the weight that does not depend on the document."""
    idf = _idf(index)
    base = F.col("boost") * F.col("counted") * idf * idf
    return words.select("query_id", "clause_id", "bucket", "field", "term", "df", *_QUERY_FLAGS, F.lit(False).alias("constant"), base.alias("base"))


def _term_hits(words: DataFrame, index: Index, tasks: int, lead: DataFrame | None = None) -> DataFrame:
    """Written words to weighted matches, one row per word and document.

    The postings of a word go to their documents' tasks once, however many queries ask for it. Words beyond
    BROADCAST_BYTES meet their postings with their queries. A written ``lead (query_id, doc_id)`` that is small leaves
    out what lies in no document of its query.
    """
    weight = F.col("base") * F.sqrt("tf") / F.sqrt("len")
    few = lead is not None and lead.count() * WORD_BYTES <= BROADCAST_BYTES
    if words.agg(F.coalesce(F.sum(_word_bytes()), F.lit(0))).first()[0] > BROADCAST_BYTES:
        hits = _by_document(_meet(words, index, "tf", "len").withColumn("weight", weight).select(*_HIT), tasks)
    else:
        keys = ["bucket", "field", "term"]
        each = written(words.select(*keys).distinct().withColumn("word", F.monotonically_increasing_id()), "distinct-words")
        asked = written(words.join(each, keys).drop(*keys, "df"), "words-asked")
        met = _meet(each, index, "tf", "len").select("doc_id", "word", "tf", "len")
        if few:
            met = met.join(F.broadcast(lead.select("doc_id").distinct()), "doc_id", "left_semi")
        hits = _by_document(met, tasks).join(F.broadcast(asked), "word").withColumn("weight", weight).select(*_HIT)
    return hits.join(F.broadcast(lead), ["query_id", "doc_id"], "left_semi") if few else hits


def _exact_hits(clauses: DataFrame, index: Index) -> DataFrame:
    """Documents of an id or a path, weighted like a word that they hold alone."""
    asked = clauses.where("kind = 'exact'").select("query_id", "clause_id", "field", "term", "boost", *_QUERY_FLAGS)
    held = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("term")) for c in EXACT_FIELDS])
    docs = index.docs().select("doc_id", F.inline(held))
    found = written(asked.join(docs, ["field", "term"]), "exact-docs")
    many = found.groupBy("query_id", "clause_id").agg(F.count("*").alias("df"))
    weight = F.col("boost") * F.col("counted") * _idf(index) * _idf(index)
    return found.join(many, ["query_id", "clause_id"]).withColumns({"constant": F.lit(False), "weight": weight}).select(*_HIT)


def rejected_clauses(clauses: DataFrame) -> DataFrame:
    """``query_id, clause_id, kind, term, reason``: clauses that cannot be read, whose queries give no results."""
    return with_reasons(clauses).where("reason is not null").select("query_id", "clause_id", "kind", "term", "reason")


def _accepted(clauses: DataFrame) -> DataFrame:
    """The queries without a rejected clause, with the ``runs`` of their regular expressions."""
    read = written(with_reasons(clauses), "clauses-read")
    wrong = read.where("reason is not null").select("query_id").distinct()
    return read.join(wrong, "query_id", "left_anti").drop("reason")


# What a pattern is, apart from the clauses that ask for it.
_PATTERN = ["field", "kind", "term", "upper", "slop"]


def _expanded_hits(clauses: DataFrame, index: Index, kinds, tasks: int, best: int | None = None) -> DataFrame:
    """Patterns, ranges and misspelt words to weighted matches, one row per clause and document.

    Misspelt words of which only the ``best`` documents are asked are summed up for each query and document of a task.

    Equal patterns of several clauses meet the dictionary and the postings once, and a word's postings are read and dealt to their
    documents' tasks once, whatever asks for it: the word brings the patterns that it stands for, or the segment of the dictionary
    that it lies in. A pattern counts once per document
    with weight 1; the words that a misspelt one stands for add up, as whole billionths, so that their order does not matter.
    """
    lowered = {
        "term": F.when(F.col("kind") == "regexp", F.col("term")).otherwise(F.coalesce(F.lower("term"), F.lit(""))),
        "upper": F.lower("upper"),
        "slop": F.when(F.col("kind") == "fuzzy", F.col("slop")).otherwise(0),
    }
    own = clauses.where(F.col("kind").isin(*EXPANDED_KINDS)).withColumns(lowered)
    runs = F.first("runs") if "runs" in own.columns else F.lit(None).cast("array<string>")
    patterns = own.groupBy(*_PATTERN).agg(runs.alias("runs"))
    # one row for each pattern of the batch
    patterns = patterns.withColumn("pattern", F.row_number().over(Window.orderBy(*_PATTERN)) - 1)
    patterns = written(patterns, "patterns")
    same = own["upper"].eqNullSafe(patterns["upper"])
    for c in ("field", "kind", "term", "slop"):
        same &= own[c] == patterns[c]
    asked = own.join(patterns, same).select("pattern", "query_id", "clause_id", "boost", *_QUERY_FLAGS, patterns["kind"].alias("as"))
    asked = written(asked.withColumn("constant", F.col("as") != "fuzzy").drop("as"), "pattern-clauses")
    if best is not None and set(kinds) & set(EXPANDED_KINDS) == {"fuzzy"}:
        words = _pattern_words(patterns.where("kind = 'fuzzy'"), index, ("fuzzy",))
        found = _best_sums(words, asked.where("not constant"), index, tasks, best)
        if found is not None:
            return found
    units = []
    if spans := set(kinds) & set(SPAN_KINDS):
        units.append(_span_units(patterns.where(F.col("kind").isin(*spans)), index, tasks))
    if others := set(kinds) & set(EXPANDED_KINDS) - set(SPAN_KINDS):
        units.append(_pattern_units(patterns.where(F.col("kind").isin(*others)), index, others, tasks))
    hits = _union(units).join(_small(asked, asked.count() * WORD_BYTES), "pattern")
    unit = F.when(F.col("constant"), 1.0).otherwise(F.col("unit"))
    return hits.withColumn("weight", F.col("boost") * F.col("counted") * unit).select(*_HIT)


def _bucketed(words: DataFrame, index: Index) -> DataFrame:
    return words.withColumn("bucket", bucket_of(index.buckets, F.col("field"), F.col("term")))


def _span_units(patterns: DataFrame, index: Index, tasks: int) -> DataFrame:
    """``pattern, doc_id, unit``: the documents of prefixes and ranges, by the segments of the dictionary that their ends cut.

    A word lies in one segment, however many ranges hold it. A document's segments are gone through in order, and a range counts
    at the first of them that it holds.
    """
    words, covers = segments(patterns, Dictionary(index))
    words = written(_bucketed(words, index), "segment-words")
    met = _by_document(_meet(words, index).select("doc_id", "segment"), tasks).distinct()
    before = F.lag("segment").over(Window.partitionBy("doc_id").orderBy("segment"))
    met = met.withColumn("before", F.coalesce(before, F.lit(-1)))
    held = met.join(_small(covers, covers.count() * WORD_BYTES // 2), "segment").where("start > before")
    return held.select("pattern", "doc_id", F.lit(1.0).alias("unit"))


def _pattern_words(patterns: DataFrame, index: Index, kinds) -> DataFrame:
    """The words that patterns stand for, with the ``patterns`` of each and its idf squared."""
    idf = _idf(index)
    words = _bucketed(expand(patterns, Dictionary(index), kinds), index)
    words = words.groupBy("bucket", "field", "term", "df").agg(F.sort_array(F.collect_list("pattern")).alias("patterns"))
    return written(words.withColumn("base", idf * idf).drop("df"), "pattern-words")


def _part() -> Column:
    """A word's part in a misspelt one's weight, in billionths."""
    return F.floor(F.col("base") * F.sqrt("tf") / F.sqrt("len") * 1e9 + 0.5).alias("part")


def _best_sums(words: DataFrame, asked: DataFrame, index: Index, tasks: int, best: int) -> DataFrame | None:
    """Misspelt words to weighted matches, one row per query and document, of the documents of each task that can be among a query's
    best. A document's words bring their patterns and meet the clauses there, so no table holds documents times patterns or clauses.
    None if the clauses are too many to be broadcast.
    """
    if asked.count() * WORD_BYTES > BROADCAST_BYTES:
        return None
    queries = written(asked.select("query_id", "n_must", "n_scoring").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    weight = (F.col("boost") * F.col("counted")).alias("weight")
    rows = asked.join(queries.select("query_id", "query"), "query_id").select("query", "pattern", weight, "counted", "n_scoring")
    clauses = {c: v.to_numpy() for c, v in zip(rows.columns, rows.orderBy("query", "pattern").toArrow().columns, strict=True)}
    numbers, first = np.unique(clauses["query"], return_index=True)
    if not len(numbers):
        return None
    sent = {
        "n_patterns": int(clauses["pattern"].max()) + 1, "pattern": clauses["pattern"], "weight": clauses["weight"], "counted": clauses["counted"].astype(np.int64),
        "queries": numbers, "first": first, "scoring": clauses["n_scoring"][first],
    }
    met = _meet(words, index, "tf", "len").select("doc_id", "patterns", _part())
    met = _by_document(met, tasks).sortWithinPartitions("doc_id")
    found = met.mapInArrow(together.best_sums(index.spark.sparkContext.broadcast(sent), best), f"doc_id {index.id_type}, query long, weight double, counted long")
    flags = {"constant": F.lit(False), "clause_id": F.lit(None).cast(dict(asked.dtypes)["clause_id"]), "must": F.lit(0), "prohibited": F.lit(0)}
    return _by_document(found, tasks).join(F.broadcast(queries), "query").withColumns(flags).select(*_HIT)


def _pattern_units(patterns: DataFrame, index: Index, kinds, tasks: int) -> DataFrame:
    """``pattern, doc_id, unit``: the documents of wildcards, regular expressions and misspelt words."""
    words = _pattern_words(patterns, index, kinds)
    met = _meet(words, index, "tf", "len").select("doc_id", "patterns", _part())
    each = _by_document(met, tasks).select("doc_id", F.explode("patterns").alias("pattern"), "part")
    return each.groupBy("pattern", "doc_id").agg((F.sum("part") / 1e9).alias("unit"))


def _phrase_parts(words: DataFrame, index: Index) -> DataFrame:
    """What a phrase is looked up by, one row each: words, and pairs of neighbours (``second`` is set) of which one is common.

    A word that is in a pair is not looked up by itself, so an exact phrase of two words or more never reads the
    postings of a common word that has a neighbour. Phrases with a word that no document holds drop out. ``idf`` is the
    sum over the phrase's words, ``rarity`` counts from the part that the fewest documents can hold.
    """
    each = Window.partitionBy("query_id", "clause_id")  # the words of one phrase
    row = each.orderBy("i")
    common = Dictionary(index).is_common(F.col("df"))
    known = _look_up(words, index).withColumns({"found": F.count("*").over(each), "idf": F.sum(_idf(index)).over(each), "common": common})

    def beside(step: int) -> Column:
        """The neighbour in the phrase, if the two are looked up together."""
        there = lambda c: F.lead(c, step).over(row)
        together = (F.col("slop") == 0) & (there("i") == F.col("i") + step) & (F.col("common") | there("common"))
        return F.when(together, F.struct(there("term").alias("term"), there("df").alias("df")))

    known = known.where("found = n_terms").withColumns({"next": beside(1), "last": beside(-1)})
    alone = F.when(F.col("next").isNull() & F.col("last").isNull(), F.struct(F.lit(None).cast("string").alias("second"), F.col("df").alias("most")))
    pair = F.when(F.col("next").isNotNull(), F.struct(F.col("next.term").alias("second"), F.least("df", "next.df").alias("most")))
    parts = known.withColumn("part", F.explode(F.array(alone, pair))).where("part is not null").select("*", "part.*")
    two = (F.col("slop") > 0) & (F.col("n_terms") == 2) & (F.min("i").over(each) == 0) & (F.max("i").over(each) > 0)
    parts = parts.withColumns(
        {
            "near": two & (F.max("i").over(each) + F.col("slop") <= NEAR),
            "n_parts": F.count("*").over(each),
            "rarity": F.row_number().over(each.orderBy("most", F.col("second").isNull(), "i")),
            "shelf": shelf_of(F.col("term"), F.col("second")),
        }
    )
    return written(parts.drop("part", "next", "last", "common", "found", "df"), "phrase-parts")


def _phrase_hits(words: DataFrame, index: Index, tasks: int) -> DataFrame:
    """Documents that hold all words of a phrase in place, one row per clause and document.

    Each part's places are read and dealt to their documents' tasks once, whatever asks for it. There the documents of
    a phrase's rarest part ask for its other parts; where those documents are few, the places in others are dropped before. Two words with slop
    are counted in one pass over a document, however many phrases there are.
    """
    parts = _phrase_parts(words, index)
    count = parts.agg(F.count_if("near").alias("near"), F.count_if(~F.col("near")).alias("others")).first()
    if count.near * WORD_BYTES > BROADCAST_BYTES:
        return _placed_hits(parts, index, tasks)
    frames = [_near_hits(parts.where("near"), index, tasks)] if count.near else []
    if count.others or not frames:
        frames.append(_placed_hits(parts.where("not near"), index, tasks))
    return _union(frames)


def _near_hits(parts: DataFrame, index: Index, tasks: int) -> DataFrame:
    """Documents that hold the two words of a phrase near each other, one row per clause and document.

    The places of each word are read and dealt to their documents' tasks once. There a document's words are laid in order, and each is held
    against those beside it, whatever the number of phrases; equal phrases are counted once.
    """
    keys, place = ["query_id", "clause_id"], ["bucket", "field", "term"]
    each = written(parts.select(*place).distinct().withColumn("part", F.monotonically_increasing_id()), "near-words")
    what = [F.min_by("part", "i").alias("first"), F.max_by("part", "i").alias("second"), F.max("i").alias("gap"), (F.min_by("i", "rarity") == 0).alias("leads")]
    flags = [F.first(c).alias(c) for c in (*_QUERY_FLAGS, "slop", "boost", "idf")]
    pairs = written(parts.join(each, place).groupBy(*keys).agg(*what, F.sum(F.when(F.col("rarity") == 1, F.col("most"))).alias("docs"), *flags), "near-pairs")
    same = ["first", "second", "gap", "slop", "leads"]
    phrases = written(pairs.select(*same).distinct().withColumn("phrase", F.monotonically_increasing_id()), "near-phrases")
    asked = written(pairs.join(phrases, same).select("phrase", *keys, *_QUERY_FLAGS, "boost", "idf"), "near-clauses")
    ids = np.array([r.part for r in each.select("part").orderBy("part").toLocalIterator()], np.int64)
    own: dict[tuple[int, int], dict] = {}
    all_of = phrases.toArrow()
    read = {c: all_of[c].to_numpy() for c in (*same, "phrase")}
    read |= {c: np.searchsorted(ids, read[c]) for c in ("first", "second")}
    for gap, slop in {*zip(read["gap"].tolist(), read["slop"].tolist(), strict=True)}:
        at = np.flatnonzero((read["gap"] == gap) & (read["slop"] == slop))
        at = at[np.argsort(read["first"][at] * len(ids) + read["second"][at])]
        own[gap, slop] = {c: read[c][at] for c in ("first", "second", "phrase", "leads")}
    met = _meet(each, index, "pos", "len").select("doc_id", "len", "part", "pos")
    if pairs.agg(F.sum("docs")).first()[0] * WORD_BYTES <= BROADCAST_BYTES:
        rarest = pairs.select(F.when(F.col("leads"), F.col("first")).otherwise(F.col("second")).alias("part")).distinct()
        lead = written(_meet(written(each.join(rarest, "part"), "rarest-words"), index).select("doc_id").distinct(), "near-docs")
        met = met.join(F.broadcast(lead), "doc_id", "left_semi")
    met = _by_document(met, tasks).sortWithinPartitions("doc_id", "len")
    sent = index.spark.sparkContext.broadcast({"parts": ids, "phrases": own})
    found = met.mapInArrow(together.near_words(sent), f"doc_id {index.id_type}, len int, phrase long, freq long")
    hits = _by_document(found, tasks).join(_small(asked, asked.count() * WORD_BYTES), "phrase")
    weight = F.col("boost") * F.col("counted") * F.sqrt("freq") * F.col("idf") * F.col("idf") / F.sqrt("len")
    return hits.withColumns({"constant": F.lit(False), "weight": weight}).select(*_HIT)


def _placed_hits(parts: DataFrame, index: Index, tasks: int) -> DataFrame:
    """The documents of phrases of any length, by all places of their words; see :func:`_phrase_hits`."""
    keys = ["query_id", "clause_id"]
    place = ["bucket", "shelf", "field", "term", "second"]
    each = written(parts.select(*place).distinct().withColumn("part", F.monotonically_increasing_id()), "distinct-parts")
    same = parts["second"].eqNullSafe(each["second"])
    for c in place[:-1]:
        same &= parts[c] == each[c]
    parts = written(parts.join(each, same).select(*[parts[c] for c in parts.columns if c not in place], each["part"]), "parts-asked")
    rarest = parts.where("rarity = 1").select(*keys, F.col("part").alias("lead"), "most")
    first = written(each.join(rarest.select(F.col("lead").alias("part")).distinct(), "part", "left_semi"), "rarest-parts")
    pair = F.col("second").isNotNull()

    def met(some: DataFrame, *columns: str | Column) -> DataFrame:
        """Parts joined to where they stand; pairs by reading their shelves between the first and the last of them."""
        size = F.octet_length("term") + F.octet_length("second") + F.octet_length("field") + WORD_BYTES
        of_pairs = {"bytes": F.sum(F.when(pair, size)), "low": F.min(F.when(pair, F.col("term"))), "high": F.max(F.when(pair, F.col("term")))}
        # one row with at most SHELVES numbers
        shelves = F.collect_set(F.when(pair, F.col("shelf"))).alias("shelves")
        span = some.agg(shelves, F.count_if(~pair).alias("words"), *[c.alias(n) for n, c in of_pairs.items()]).first()
        frames = []
        if span.words or not span.shelves:
            frames.append(_meet(some.where(~pair), index, "pos", "len").select(*columns))
        if span.shelves:
            pairs = some.where(pair).drop("bucket")
            held = Dictionary(index).pairs().withColumnRenamed("first", "term")
            held = held.where(F.col("shelf").isin(span.shelves) & F.col("term").between(span.low, span.high))
            frames.append(_small(pairs, span.bytes).join(held, ["shelf", "field", "term", "second"]).select(*columns))
        return _union(frames)

    count = rarest.agg(F.count("*").alias("phrases"), F.coalesce(F.sum("most"), F.lit(0)).alias("docs")).first()
    lead = met(first, "doc_id", "len", F.col("part").alias("lead"))
    places = met(each, "doc_id", "len", "part", "pos")
    if count.docs * WORD_BYTES <= BROADCAST_BYTES:
        lead = written(lead, "phrase-docs")
        places = places.join(F.broadcast(lead.select("doc_id").distinct()), "doc_id", "left_semi")
    # what a document of the rarest part asks for: a row for each part of the phrase
    wanted = written(rarest.drop("most").join(parts.select(*keys, "part", "i"), keys), "parts-wanted")
    wanted = _small(wanted, wanted.count() * WORD_BYTES)
    asking = _by_document(lead, tasks).distinct().join(wanted, "lead").select("doc_id", "len", "part", *keys, "i", F.lit(None).cast("array<int>").alias("pos"))
    held = _by_document(places, tasks)
    held = held.select("doc_id", "len", "part", *[F.lit(None).cast(t).alias(c) for c, t in asking.dtypes if c in (*keys, "i")], "pos")
    here = Window.partitionBy("doc_id", "len", "part")
    # one list of positions, or one for each row of a document that came several times
    found = held.unionByName(asking).withColumn("lists", F.collect_list("pos").over(here)).where("i is not null")
    found = found.select("doc_id", "len", *keys, "i", F.col("part").alias("term"), F.explode("lists").alias("pos"))
    gathered = found.groupBy(*keys, "doc_id", "len").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("i", "term", "pos"))).alias("w"))
    phrases = written(parts.where("rarity = 1").select(*keys, *_QUERY_FLAGS, "n_parts", "slop", "boost", "idf"), "phrases")
    known = gathered.join(_small(phrases, count.phrases * WORD_BYTES), keys).where("n = n_parts")
    scored = known.withColumn("freq", phrase_frequency(F.col("w"), F.col("slop"))).where("freq > 0")
    weight = F.col("boost") * F.col("counted") * F.sqrt("freq") * F.col("idf") * F.col("idf") / F.sqrt("len")
    return scored.withColumn("constant", F.lit(False)).withColumn("weight", weight).select(*_HIT)


def phrase_frequency(words: Column, slop: Column) -> Column:
    """How many positions of the first word start a match of ``array<struct<i, term, pos>>``.

    A word at position p whose place in the phrase is i counts as p - i. A match is a window of
    ``slop`` + 1 such values that every word falls into, so the windows of all words are
    intersected; with slop 0 that is the exact phrase. A word that occurs twice in the phrase
    needs two different positions in the window.
    """

    def windows(w: Column) -> Column:
        exact = F.transform(w["pos"], lambda p: p - w["i"])
        loose = F.flatten(F.transform(w["pos"], lambda p: F.sequence(p - w["i"] - slop, p - w["i"])))
        return F.when(slop == 0, exact).otherwise(loose)

    def placed(ws: Column, name: Column, start: Column, first: Column, beside: Column | None = None) -> Column:
        """The last position given out when the first word stands at ``first`` and every other use of a word gets a
        position of its own, earliest first. Only positions ``beside`` are looked at, if they are given."""
        return F.aggregate(
            F.filter(F.slice(ws, 2, F.size(ws)), lambda w: w["term"] == name),
            F.lit(-1),
            lambda last, w: F.array_min(
                F.filter(w["pos"] if beside is None else beside, lambda p: (p > last) & (p != first) & (p >= start + w["i"]) & (p <= start + w["i"] + slop))
            ),
        )

    def common(ws: Column) -> Column:
        return F.aggregate(
            F.slice(ws, 2, F.size(ws)), F.array_distinct(windows(ws[0])), lambda acc, w: F.array_intersect(acc, windows(w))
        )

    def count(ws: Column, found: Column) -> Column:
        names = F.array_distinct(F.transform(ws, lambda w: w["term"]))

        def apart(p: Column) -> Column:
            here = F.filter(found, lambda s: (s >= p - slop) & (s <= p))
            return F.exists(here, lambda s: F.forall(names, lambda name: placed(ws, name, s, p).isNotNull()))

        def apart_from_itself(p: Column, k: Column) -> Column:
            """As :func:`apart` for one word repeated: what can match lies within so many places, and as many positions, of p."""
            reach = 2 * slop + F.array_max(F.transform(ws, lambda w: w["i"])) + 1
            start = F.greatest(k - reach, F.lit(0))
            own = lambda x, s: (x >= s + ws[0]["i"]) & (x <= s + ws[0]["i"] + slop)
            return bind(
                F.slice(ws[0]["pos"], start + 1, 2 * reach + 1),
                lambda near: F.exists(
                    F.sequence(p - slop, p), lambda s: F.exists(near, lambda x: own(x, s)) & placed(ws, ws[0]["term"], s, p, near).isNotNull()
                ),
            )

        # positions differ within a document, so one pass over both lists counts them
        near = F.array_intersect(ws[0]["pos"], F.flatten(F.transform(found, lambda s: F.sequence(s, s + slop))))
        repeated = F.size(names) < F.size(ws)
        one_word = repeated & (F.size(names) == 1)
        return F.when(slop == 0, F.size(found)).when(one_word, F.size(F.filter(ws[0]["pos"], apart_from_itself))).when(repeated, F.size(F.filter(ws[0]["pos"], apart))).otherwise(F.size(near))

    return bind(words, lambda ws: bind(common(ws), lambda found: count(ws, found)))


def clause_hits(index: Index, clauses: DataFrame, kinds=KINDS, occurs=OCCURS, best: int | None = None) -> DataFrame:
    """Weighted matches of every clause. Name the ``kinds`` and ``occurs`` that the clauses hold
    to leave the other branches out of the plan. With ``best`` matches may be left out, and clauses summed up, of documents that cannot be among
    the best so many of their query."""
    clauses = without_stop_words(clauses, index.stop_words)
    if {"regexp", "fuzzy"} & set(kinds):
        clauses = _accepted(clauses)
    clauses = _with_totals(clauses)
    tasks = _tasks(index, clauses)
    branches = []
    if "term" in kinds:
        # written: the dictionary is read once, and the number of words is known
        words = written(_weighted(_look_up(_single_terms(clauses), index), index), "words")
        branches.append(_required_first(words, index, tasks) if "must" in occurs else _term_hits(words, index, tasks))
    if set(kinds) & set(EXPANDED_KINDS):
        only = set(kinds) == {"fuzzy"} and set(occurs) == {"should"}
        branches.append(_expanded_hits(clauses, index, kinds, tasks, best if only else None))
    if "exact" in kinds:
        branches.append(_exact_hits(clauses, index))
    if "phrase" in kinds:
        branches.append(_phrase_hits(_phrase_terms(clauses, index.stop_words), index, tasks))
    hits = _union(branches)
    return hits if set(occurs) - {"should"} else hits.drop("must", "prohibited", "n_must")


def _required_first(words: DataFrame, index: Index, tasks: int) -> DataFrame:
    """Matches of queries with required words, kept only in documents that hold the rarest where those are few. Where they are
    many, :func:`scored` leaves the others out in the documents' tasks."""
    rarest = words.where("must = 1").groupBy("query_id").agg(F.min(F.struct("df", "clause_id")).alias("rarest"))
    marked = written(words.join(rarest, "query_id", "left"), "words")
    bound, free = marked.where("rarest is not null"), marked.where("rarest is null")
    frames = []
    if not bound.isEmpty():
        lead = bound.where((F.col("must") == 1) & (F.col("clause_id") == F.col("rarest.clause_id")))
        lead = written(_meet(lead, index).select("query_id", "doc_id"), "required-docs")
        frames.append(_term_hits(bound.drop("rarest"), index, tasks, lead))
    if not frames or not free.isEmpty():
        frames.append(_term_hits(free.drop("rarest"), index, tasks))
    return _union(frames)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def scored(hits: DataFrame) -> DataFrame:
    """``query_id, doc_id, score``: documents with every required and no prohibited clause.

    The score is the sum of the clause weights times the share of clauses that matched.
    """
    sums = [F.sum("weight").alias("total"), F.sum("counted").alias("matched"), F.max("n_scoring").alias("n_scoring")]
    kept = F.col("matched") > 0
    if "must" in hits.columns:
        sums += [F.sum("must").alias("met"), F.sum("prohibited").alias("against"), F.max("n_must").alias("n_must")]
        kept &= (F.col("met") == F.col("n_must")) & (F.col("against") == 0)
    score = F.round(F.col("total") * F.col("matched") / F.col("n_scoring"), 6)
    per_doc = hits.groupBy("query_id", "doc_id").agg(*sums)
    return per_doc.where(kept).select("query_id", "doc_id", score.alias("score"))


def top_k(results: DataFrame, k: int = TOP_K) -> DataFrame:
    """Rank results per query and keep the first ``k``; ties go to the smaller document id.

    Spark keeps at most ``k`` rows per query and partition before the shuffle, up to its
    threshold for ``k``; beyond that the queries are cut into shards for a first round.
    """
    limit = int(results.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    order = [F.desc("score"), F.asc("doc_id")]
    if k > limit:
        part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
        results = results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", part).orderBy(*order)))
        results = results.where(F.col("rank") <= k).drop("rank")
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "score", "doc_id")


def search(index: Index, clauses: DataFrame, k: int = TOP_K, kinds=KINDS, occurs=OCCURS) -> DataFrame:
    """``query_id, rank, score, doc_id``: the best ``k`` documents of every query."""
    return top_k(scored(clause_hits(index, clauses, kinds, occurs, best=k)), k)


def match_all(index: Index, query_id: int = 0, boost: float = 1.0) -> DataFrame:
    """Every live document with a constant score."""
    return index.docs().select(F.lit(query_id).alias("query_id"), "doc_id", F.lit(float(boost)).alias("score"))


def any_of(*results: DataFrame) -> DataFrame:
    """Documents in any of the results, with their scores added up."""
    return _union(list(results)).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def all_of(*results: DataFrame) -> DataFrame:
    """Documents in all of the results (each without repeats), with their scores added up."""
    both = _union(list(results)).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    return both.where(F.col("n") == len(results)).drop("n")


def none_of(results: DataFrame, prohibited: DataFrame) -> DataFrame:
    """Results without the prohibited documents of the same query."""
    return results.join(prohibited.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def result_view(hits: DataFrame, messages: DataFrame) -> DataFrame:
    """Hits with what a reader sees of the message; ``messages`` holds
    ``doc_id, subject, from array<string>, sent, size, path``."""
    shown = messages.select(
        "doc_id",
        F.coalesce("subject", F.lit("")).alias("subject"),
        F.array_join("from", "; ").alias("sender"),
        F.date_format("sent", "yyyy-MM-dd HH:mm:ss").alias("sent"),
        "size",
        F.concat(F.lit("?file="), F.url_encode("path")).alias("link"),
    )
    # the few hits are written first, so that the message table is read but not shuffled for them
    return written(hits, "hits").join(shown, "doc_id").select("query_id", "rank", "score", *shown.columns)


def fetch(requests: DataFrame, messages: DataFrame, key: str = "path") -> DataFrame:
    """Requested messages with ``status`` found or missing."""
    known = messages.withColumn("status", F.lit("found"))
    return requests.join(known, key, "left").withColumn("status", F.coalesce("status", F.lit("missing")))
