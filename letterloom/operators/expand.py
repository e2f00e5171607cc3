"""Dictionary terms that a pattern, a range or a misspelt word stands for.

A batch of patterns meets the dictionary through its layouts (:mod:`dictionary`), never as every pattern against every
term: prefixes and ranges read the parts that lie between their ends, wildcards and regular expressions the terms that hold their
rarest grams, misspelt words the terms that share a spelling key. Only a pattern that fixes no gram is held against all terms of
its field.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions import patterns as reading
from letterloom.functions import together
from letterloom.operators.dictionary import MAX_EDITS, SPELLED_LETTERS, Dictionary, grams_of, on_shelves, shelf_of, spellings_of
from letterloom.session import written

# the reader of patterns travels with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(reading)
cloudpickle.register_pickle_by_value(together)

# Kinds that stand for all words between two ends.
SPAN_KINDS = ("prefix", "range")
PATTERN_KINDS = ("prefix", "wildcard", "regexp", "range")
EXPANDED_KINDS = (*PATTERN_KINDS, "fuzzy")
# Grams of a pattern that are looked up: the rarest.
GRAMS_READ = 2
# Misspelt words of a batch up to which the dictionary's terms are held against them as they are read, without a layout.
SPELT_AT_ONCE = 50_000
# Follows every word that starts with what stands before it.
_LAST_SIGN = "\U0010ffff"


def with_reasons(clauses: DataFrame) -> DataFrame:
    """``clauses`` with ``reason`` (null: the clause is taken) and ``runs``, the literal runs of a regular expression."""
    kept = clauses.columns
    # only expressions go to Python, each once
    asked = clauses.where("kind = 'regexp' and term is not null").select(F.col("term").alias("asked")).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [reading.read_pattern(p) for p in batch.column(0).to_pylist()]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["asked", "wrong", "runs"])

    known = asked.mapInArrow(read, "asked string, wrong string, runs array<string>")
    rows = clauses.join(known, (F.col("kind") == "regexp") & (F.col("term") == F.col("asked")), "left")
    edits = F.format_string(f"%s edits, not 0 to {MAX_EDITS}", "slop")
    reason = (
        F.when(~F.coalesce(F.col("kind").isin("term", "phrase", "exact", *EXPANDED_KINDS), F.lit(False)), F.lit("unknown kind"))
        .when(F.col("term").isNull() & (F.col("kind") != "range"), F.lit("no term"))
        .when((F.col("kind") == "fuzzy") & ~F.coalesce(F.col("slop").between(0, MAX_EDITS), F.lit(False)), edits)
        .otherwise(F.col("wrong"))
    )
    return rows.select(*kept, reason.alias("reason"), "runs")


def expand(patterns: DataFrame, dictionary: Dictionary, kinds=EXPANDED_KINDS) -> DataFrame:
    """``pattern, field, term, df``: the terms of each of the written ``patterns (pattern, field, kind, term, upper, slop, runs)``."""
    found = []
    if {"prefix", "range"} & set(kinds):
        found.append(_between(patterns.where("kind in ('prefix', 'range')"), dictionary))
    if {"wildcard", "regexp"} & set(kinds):
        found += _by_grams(patterns.where("kind in ('wildcard', 'regexp')"), dictionary)
    if "fuzzy" in kinds:
        found.append(_misspelt(patterns.where("kind = 'fuzzy'"), dictionary))
    return reduce(DataFrame.unionByName, found)


def _spans(patterns: DataFrame) -> DataFrame:
    """``pattern, field, first, last`` of prefixes and ranges."""
    prefix = F.col("kind") == "prefix"
    low = F.coalesce(F.lower("term"), F.lit(""))
    high = F.coalesce(F.when(prefix, F.concat(low, F.lit(_LAST_SIGN))).otherwise(F.lower("upper")), F.lit(_LAST_SIGN))
    return patterns.select("pattern", "field", low.alias("first"), high.alias("last"))


def segments(patterns: DataFrame, dictionary: Dictionary) -> tuple[DataFrame, DataFrame]:
    """Prefixes and ranges as segments of the dictionary that no end of theirs parts: ``segment, field, term``, a row for each word,
    and ``segment, pattern, start``, the segments of each pattern with its first. Segments are numbered in order."""
    # no word lies between a last word and that word with a sign of code 0 behind it
    spans = _spans(patterns).where("first <= last").select("pattern", "field", "first", F.concat("last", F.lit("\0")).alias("stop"))
    spans = written(spans, "spans")
    ends = spans.select("field", F.col("first").alias("low")).union(spans.select("field", "stop")).distinct()
    # two rows at most for each pattern of the batch
    order = Window.orderBy("field", "low")
    ends = ends.select("field", "low", F.row_number().over(order).alias("segment"), F.lead("low").over(Window.partitionBy("field").orderBy("low")).alias("high"))
    ends = written(ends, "segment-ends")
    starts = ends.select("field", F.col("low").alias("first"), F.col("segment").alias("start"))
    stops = ends.select("field", F.col("low").alias("stop"), F.col("segment").alias("end"))
    covers = spans.join(starts, ["field", "first"]).join(stops, ["field", "stop"])
    covers = covers.select("pattern", "start", F.explode(F.expr("sequence(start, end - 1)")).alias("segment"))
    covers = written(covers, "segments-covered")
    used = ends.join(covers.select("segment").distinct(), "segment", "left_semi")
    reached = used.join(dictionary.fences().withColumnsRenamed({"low": "head", "high": "tail"}), "field")
    reached = written(reached.where("tail >= low and head < high").select("segment", "field", "part", "low", "high"), "reached-parts")
    parts = reached.agg(F.collect_set("part")).first()[0]  # at most MAX_PARTS numbers
    words = dictionary.words().where(F.col("part").isin(parts))
    return reached.join(words, ["field", "part"]).where("term >= low and term < high").select("segment", "field", "term"), covers


def _between(patterns: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Prefixes and ranges: ranges include both ends, a null end is open."""
    spans = _spans(patterns)
    # a row for each part that a pattern reaches into
    reached = spans.join(dictionary.fences(), "field").where("high >= first and low <= last").select("pattern", "field", "part", "first", "last")
    reached = written(reached, "reached-parts")
    parts = reached.agg(F.collect_set("part")).first()[0]  # at most MAX_PARTS numbers
    words = dictionary.words().where(F.col("part").isin(parts))
    return reached.join(words, ["field", "part"]).where("term >= first and term <= last").select("pattern", "field", "term", "df")


def wildcard_regex(pattern: Column) -> Column:
    """``th?s*`` as an anchored regular expression; every other sign stands for itself."""
    quoted = F.regexp_replace(pattern, r"([^\p{L}\p{N}*?])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def _by_grams(patterns: DataFrame, dictionary: Dictionary) -> list[DataFrame]:
    """Wildcards and regular expressions: terms that hold their rarest grams are verified."""
    wild = F.col("kind") == "wildcard"
    marked = F.concat(F.lit("^"), F.lower("term"), F.lit("$"))
    regex = F.when(wild, wildcard_regex(F.lower("term"))).otherwise(F.concat(F.lit("^(?:"), F.col("term"), F.lit(")$")))
    runs = F.when(wild, F.split(marked, r"[*?]+")).otherwise(F.coalesce("runs", F.array().cast("array<string>")))
    grams = F.array_distinct(F.flatten(F.transform(runs, grams_of)))
    asked = written(patterns.select("pattern", "field", regex.alias("regex"), grams.alias("grams")), "patterns-read")
    wanted = asked.select("pattern", "field", F.explode("grams").alias("gram")).join(dictionary.gram_counts(), ["field", "gram"], "left")
    # a gram that no term holds (n is null) ends its pattern
    rarest = F.row_number().over(Window.partitionBy("pattern").orderBy("n", "gram"))
    wanted = wanted.withColumn("nth", rarest).where(F.col("nth") <= GRAMS_READ).withColumn("shelf", shelf_of(F.col("gram")))
    wanted = written(wanted.select("pattern", "field", "gram", "n", "shelf"), "grams-wanted")
    needed = wanted.groupBy("pattern").agg(F.count("*").alias("needed"), F.min(F.col("n").isNotNull()).alias("known")).where("known")
    held = wanted.select("pattern", "field", "gram", "shelf").join(on_shelves(dictionary.grams(), wanted), ["shelf", "gram", "field"])
    held = held.groupBy("pattern", "field", "term", "df").agg(F.count("*").alias("held"))
    likely = held.join(needed, "pattern").where("held = needed").join(asked.select("pattern", "regex"), "pattern")
    found = [likely.where(F.rlike("term", F.col("regex"))).select("pattern", "field", "term", "df")]
    free = asked.where(F.size("grams") == 0)
    if not free.isEmpty():
        every = free.join(dictionary.words(), "field").where(F.rlike("term", F.col("regex")))
        found.append(every.select("pattern", "field", "term", "df"))
    return found


def _misspelt(patterns: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Terms within ``slop`` edits of a word, by the spelling keys that both have.

    A batch of up to SPELT_AT_ONCE words goes to the terms, of which only those of about the words' lengths are spelt; more words meet the layout.
    """
    word = F.lower("term")
    if patterns.count() <= SPELT_AT_ONCE:
        return _misspelt_at_once(patterns.select("pattern", "field", "slop", word.alias("word")), dictionary)
    keys = patterns.select("pattern", "field", "slop", word.alias("word"), F.inline(spellings_of(word))).where("lost <= slop")
    keys = written(keys.withColumn("shelf", shelf_of(F.col("key"))).drop("lost"), "spellings-wanted")
    shelved = on_shelves(dictionary.spellings(), keys)
    near = keys.join(shelved, ["shelf", "key", "field"]).where("lost <= slop and abs(length(term) - length(word)) <= slop")
    # with a threshold the distance is -1 as soon as it is known to be larger
    near = near.where(F.levenshtein("term", "word", MAX_EDITS).between(0, F.col("slop")))
    # several keys may lead to one term
    return near.select("pattern", "field", "term", "df").distinct()


def _misspelt_at_once(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    rows = words.collect()  # at most SPELT_AT_ONCE
    least, most = min((len(r.word) - r.slop for r in rows), default=0), max((len(r.word) + r.slop for r in rows), default=0)
    by_field = {}
    for field in {r.field for r in rows}:
        own = [r for r in rows if r.field == field]
        by_field[field] = together.spelt([r.word for r in own], [r.pattern for r in own], [r.slop for r in own], SPELLED_LETTERS)
    sent = dictionary.spark.sparkContext.broadcast({"letters": SPELLED_LETTERS, "by_field": by_field})
    terms = dictionary.index.terms().select("field", "term", "df").where(F.col("field").isin(*by_field) & F.length("term").between(least, most))
    likely = terms.mapInArrow(together.likely_words(sent), "field string, term string, df bigint, patterns array<int>")
    near = likely.select("field", "term", "df", F.explode("patterns").alias("pattern")).join(F.broadcast(words.drop("field")), "pattern")
    return near.where(F.levenshtein("term", "word", MAX_EDITS).between(0, F.col("slop"))).select("pattern", "field", "term", "df")
