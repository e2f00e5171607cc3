"""An index's dictionary laid out for patterns and phrases: tables beside the index, each written when it is first asked for.

``words``      field, term, df; cut into parts by ranges of (field, term), so a prefix or a range reads the parts that ``fences`` names
``grams``      gram, field, term, df; runs of three signs of ``^term$``, on shelves by hash of the gram
``spellings``  key, lost, field, term, df; what is left of a term's first letters when up to two are lost, on shelves by hash of the key
``pairs``      field, first, second, doc_id, pos, len; where a common word stands beside another word, on shelves by hash of both
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.functions.text import bind
from letterloom.plans.index import Index
from letterloom.session import written

TERMS_PER_PART = 20_000
MAX_PARTS = 4096
SHELVES = 32
GRAM = 3
# Letters of a word that are looked at for spellings, and how many may be lost: 29 keys a term at most.
SPELLED_LETTERS = 7
MAX_EDITS = 2
ROWS_PER_FILE = 2_000_000
# A word is common if at least one of so many documents holds it. A document has at most so many common words, on
# average, as all words have, so there are few however many documents there are.
COMMON_ONE_IN = 8

_SCHEMAS = {
    "words": "field string, term string, df bigint, part int",
    "fences": "part int, field string, low string, high string",
    "grams": "gram string, field string, term string, df bigint, shelf int",
    "gram_counts": "field string, gram string, n bigint",
    "spellings": "key string, lost int, field string, term string, df bigint, shelf int",
    "pairs": "field string, first string, second string, doc_id {id}, pos array<int>, len int, shelf int",
}


def shelf_of(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SHELVES)).cast("int")


def grams_of(run: Column) -> Column:
    """The grams that a run of signs holds; ``^`` and ``$`` mark a word's ends. Two signs are a gram at an end only."""
    windows = F.transform(F.sequence(F.lit(1), F.length(run) - GRAM + 1), lambda i: F.substring(run, i, F.lit(GRAM)))
    edge = (F.length(run) == GRAM - 1) & (run.startswith("^") | run.endswith("$"))
    return F.when(F.length(run) >= GRAM, windows).when(edge, F.array(run)).otherwise(F.array().cast("array<string>"))


def _term_grams(term: Column) -> Column:
    return bind(
        F.concat(F.lit("^"), term, F.lit("$")),
        lambda m: F.array_distinct(F.concat(grams_of(m), F.array(F.left(m, F.lit(GRAM - 1)), F.right(m, F.lit(GRAM - 1))))),
    )


def spellings_of(word: Column) -> Column:
    """``array<struct<key, lost>>``: a word's first letters, and what is left when any one or two of them are lost.

    Two words within two edits share a key with no more letters lost than edits, as what two words have in common within their
    first letters lacks at most that many of each.
    """

    def without(w: Column) -> Column:
        places = F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))

    def keyed(keys: Column, lost: int) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(lost).alias("lost")))

    def all_of(start: Column) -> Column:
        return bind(
            F.array_distinct(without(start)),
            lambda one: F.concat(keyed(F.array(start), 0), keyed(one, 1), keyed(F.array_distinct(F.flatten(F.transform(one, without))), 2)),
        )

    return bind(F.left(word, F.lit(SPELLED_LETTERS)), all_of)


def _neighbours(entries: Column) -> Column:
    """``array<struct<first, second, pos>>``: words of ``array<struct<term, pos>>`` at places that follow each other."""
    places = F.flatten(F.transform(entries, lambda e: F.transform(e["pos"], lambda p: F.struct(p.alias("pos"), e["term"].alias("term")))))

    def pairs(ws: Column) -> Column:
        after = lambda i: F.get(ws, i + 1)
        both = F.transform(
            ws, lambda w, i: F.struct(w["term"].alias("first"), after(i)["term"].alias("second"), w["pos"].alias("pos"), after(i)["pos"].alias("then"))
        )
        return F.filter(both, lambda b: b["then"] == b["pos"] + 1)

    return bind(F.array_sort(places), pairs)


@dataclass(frozen=True)
class Dictionary:
    """The dictionary of one version of an index."""

    index: Index

    @property
    def spark(self) -> SparkSession:
        return self.index.spark

    def _table(self, name: str, write: Callable[[str], None]) -> DataFrame:
        path = f"{self.index.root}/dictionary/version={self.index.version}/{name}"
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            write(path)
        return self.spark.read.schema(_SCHEMAS[name].format(id=self.index.id_type)).parquet(path)

    def _terms(self) -> DataFrame:
        return self.index.terms().select("field", "term", "df")

    def words(self) -> DataFrame:
        def write(path: str) -> None:
            terms = self._terms()
            parts = min(MAX_PARTS, max(1, -(-terms.count() // TERMS_PER_PART)))
            rows = terms.repartitionByRange(parts, "field", "term").withColumn("part", F.spark_partition_id())
            rows.sortWithinPartitions("part", "field", "term").write.mode("overwrite").partitionBy("part").parquet(path)

        return self._table("words", write)

    def fences(self) -> DataFrame:
        """``part, field, low, high``: the first and last term of each field in each part."""

        def write(path: str) -> None:
            ends = self.words().groupBy("part", "field").agg(F.min("term").alias("low"), F.max("term").alias("high"))
            ends.coalesce(1).write.mode("overwrite").parquet(path)

        return self._table("fences", write)

    def grams(self) -> DataFrame:
        return self._table("grams", lambda path: self._shelved(self._terms().select("*", F.explode(_term_grams(F.col("term"))).alias("gram")), "gram", path))

    def gram_counts(self) -> DataFrame:
        return self._table("gram_counts", lambda path: self.grams().groupBy("field", "gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(path))

    def spellings(self) -> DataFrame:
        rows = self._terms().select("*", F.inline(spellings_of(F.col("term"))))
        return self._table("spellings", lambda path: self._shelved(rows, "key", path))

    def is_common(self, df: Column) -> Column:
        return df * COMMON_ONE_IN >= self.index.n_docs

    def pairs(self) -> DataFrame:
        """Neighbouring words of which at least one is common, with the places of the first in each document.

        Neighbours are found inside a document's row; only pairs with a common word are shuffled, once, by shelf and a
        slice of the documents, so the pairs of a word that most documents hold are written by many tasks.
        """

        def write(path: str) -> None:
            common = written(self._terms().where(self.is_common(F.col("df"))), "common-words")
            held = common.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
            slices = -(-2 * held // (ROWS_PER_FILE * SHELVES)) or 1
            rows = self.index.forward().select("doc_id", "field", "len", F.explode_outer(_neighbours(F.col("entries"))).alias("p"))
            rows = rows.where("p is not null").select("doc_id", "field", "len", "p.first", "p.second", "p.pos")
            for side in ("first", "second"):
                marks = common.select("field", F.col("term").alias(side), F.lit(True).alias(f"{side}_common"))
                rows = rows.join(marks, ["field", side], "left")
            rows = rows.where("first_common or second_common").drop("first_common", "second_common")
            keys = ["shelf", "slice", "field", "first", "second", "doc_id", "len"]
            rows = rows.withColumns({"shelf": shelf_of(F.col("first"), F.col("second")), "slice": F.pmod(F.xxhash64("doc_id"), F.lit(slices))})
            rows = rows.repartition("shelf", "slice").groupBy(*keys).agg(F.sort_array(F.collect_list("pos")).alias("pos")).drop("slice")
            rows.sortWithinPartitions("shelf", "field", "first", "second").write.mode("overwrite").partitionBy("shelf").parquet(path)

        return self._table("pairs", write)

    def _shelved(self, rows: DataFrame, key: str, path: str) -> None:
        """A shelf is written by as many tasks as the dictionary's size asks for, and sorted in each file."""
        tasks = -(-30 * self._terms().count() // (ROWS_PER_FILE * SHELVES)) or 1
        rows = rows.withColumn("shelf", shelf_of(F.col(key)))
        rows = rows.repartition(F.col("shelf"), F.pmod(F.xxhash64("term"), F.lit(tasks))).sortWithinPartitions("shelf", key, "field", "term")
        rows.write.mode("overwrite").partitionBy("shelf").parquet(path)


def on_shelves(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows on the shelves of the written ``wanted`` (column ``shelf``) only."""
    shelves = wanted.agg(F.collect_set("shelf")).first()[0]  # at most SHELVES numbers
    return rows.where(F.col("shelf").isin(shelves))
