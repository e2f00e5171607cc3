"""The stored text index: parquet tables, one snapshot per version.

Under the index root:

``forward/gen=G``            one row per document and field, with its terms and positions
``postings/gen=G/bucket=B``  field, term, doc_id, tf, pos, len, slice; sorted by term in a file
``slices/gen=G``             bucket, slices: into how many files a bucket is cut, by document
``terms/version=V/bucket=B`` field, term, df of the live documents
``docs/version=V``           doc_id, gen, path, id, stamp: the live documents
``removed/version=V``        doc_id, gen: documents whose postings no longer count
``versions/version=V``       one row per published version; written last, it is the commit

A refresh writes a new generation holding only new and changed documents, and small tables that
say what is live. Postings of other documents are never rewritten, and a reader that opened
version V keeps seeing V: every writer, a rebuild too, takes numbers above all published ones,
writes only from the newest version, and cannot publish a version that another one has published.
The stop words are part of a version; refreshes and searches use the ones they find there.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from letterloom.functions.text import ENGLISH_STOP_WORDS
from letterloom.operators import postings as stats
from letterloom.operators.refresh import classify, stale
from letterloom.session import written

# Schemas of the tables; {id} is the type of the document id.
SCHEMAS = {
    "forward": "doc_id {id}, field string, len int, entries array<struct<term:string,pos:array<int>>>, gen int",
    "postings": "field string, term string, doc_id {id}, tf int, pos array<int>, len int, slice int, gen int, bucket int",
    "slices": "bucket int, slices int, first int, gen int",
    "counts": "field string, term string, df bigint",
    "terms": "field string, term string, df bigint, bucket int",
    "docs": "doc_id {id}, gen int, path string, id string, stamp bigint",
    "removed": "doc_id {id}, gen int",
}

ROWS_PER_BUCKET = 20_000_000
# A task reads and sorts so many postings, about 100 MB, whatever the size of the index.
ROWS_PER_FILE = 2_000_000
MIN_BUCKETS, MAX_BUCKETS = 8, 4096


def bucket_of(buckets: int, field: Column, term: Column) -> Column:
    return F.pmod(F.xxhash64(field, term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """One published version."""

    spark: SparkSession
    root: str
    version: int
    gens: tuple[int, ...]
    buckets: int
    n_docs: int
    n_removed: int
    id_type: str
    stop_words: tuple[str, ...] = ()

    def _reader(self, name: str) -> DataFrameReader:
        return self.spark.read.schema(SCHEMAS[name].format(id=self.id_type))

    def _table(self, name: str) -> DataFrame:
        return self._reader(name).parquet(f"{self.root}/{name}/version={self.version}")

    def docs(self) -> DataFrame:
        return self._table("docs")

    def terms(self) -> DataFrame:
        return self._table("terms")

    def removed(self) -> DataFrame:
        return self._table("removed")

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (with ``doc_id`` and ``gen``) of live documents."""
        if not self.n_removed:
            return rows
        return rows.join(self.removed(), ["doc_id", "gen"], "left_anti")

    def _generations(self, name: str) -> DataFrame:
        paths = [f"{self.root}/{name}/gen={g}" for g in self.gens]
        return self._reader(name).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def raw_postings(self) -> DataFrame:
        """Postings of all generations; pass what is left of them through :meth:`live`."""
        return self._generations("postings")

    def postings(self) -> DataFrame:
        return self.live(self.raw_postings())

    def slices(self) -> DataFrame:
        """``bucket, slices``: the most slices of a bucket in any generation."""
        return self._generations("slices").groupBy("bucket").agg(F.max("slices").alias("slices"))

    def forward(self) -> DataFrame:
        return self.live(self._generations("forward"))

    def doc_len(self) -> DataFrame:
        return stats.doc_lengths(self.forward())


def open_index(spark: SparkSession, root: str, version: int | None = None) -> Index:
    """The given version, or the newest published one."""
    row = (
        _versions(spark, root)
        .where(F.lit(True) if version is None else F.col("version") == version)
        .orderBy(F.desc("version"))
        .first()
    )
    if row is None:
        raise ValueError(f"no such version in {root}")
    return Index(spark, root, row.version, tuple(row.gens), row.buckets, row.n_docs, row.n_removed, row.id_type, tuple(row.stop_words))


def _versions(spark: SparkSession, root: str) -> DataFrame:
    schema = "gens array<int>, buckets int, n_docs bigint, n_removed bigint, id_type string, stop_words array<string>, version int"
    return spark.read.schema(schema).parquet(f"{root}/versions")


def next_numbers(spark: SparkSession, root: str) -> tuple[int, int]:
    """The first version and generation above all published ones."""
    if not has_index(spark, root):
        return 1, 1
    row = _versions(spark, root).agg(F.max("version").alias("version"), F.max(F.array_max("gens")).alias("gen")).first()
    return row.version + 1, row.gen + 1


def _next_of(index: Index) -> tuple[int, int]:
    """Numbers for a writer that starts from ``index``, which must be the newest version."""
    version, gen = next_numbers(index.spark, index.root)
    if version != index.version + 1:
        raise ValueError(f"version {index.version} of {index.root} is not the newest; open version {version - 1}")
    return version, gen


def has_index(spark: SparkSession, root: str) -> bool:
    try:
        open_index(spark, root)
    except (AnalysisException, ValueError):
        return False
    return True


def _publish(index: Index) -> Index:
    row = index.spark.range(1).select(
        F.array(*[F.lit(g) for g in index.gens]).alias("gens"),
        F.lit(index.buckets).alias("buckets"),
        F.lit(index.n_docs).cast("bigint").alias("n_docs"),
        F.lit(index.n_removed).cast("bigint").alias("n_removed"),
        F.lit(index.id_type).alias("id_type"),
        F.array(*[F.lit(w) for w in index.stop_words]).cast("array<string>").alias("stop_words"),
    )
    # fails if another writer has published this version
    row.coalesce(1).write.mode("error").parquet(f"{index.root}/versions/version={index.version}")
    return index


def _write_postings(
    spark: SparkSession, root: str, gen: int, id_type: str, buckets: int | None, rows_per_file: int = ROWS_PER_FILE
) -> tuple[int, DataFrame]:
    """Lay out generation ``gen`` of the forward table by term; return buckets and term counts.

    A bucket is cut by document into as many slices as its rows need, so a word that holds a
    large share of all postings is written by many tasks, each with about as much as any other.
    """
    forward = _read(spark, "forward", id_type, f"{root}/forward/gen={gen}").drop("gen")
    counts_path = f"{root}/counts/gen={gen}"
    stats.term_counts(forward).write.mode("overwrite").parquet(counts_path)
    counts = _read(spark, "counts", id_type, counts_path)
    if buckets is None:
        total = counts.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, -(-total // ROWS_PER_BUCKET)))
    bucket = bucket_of(buckets, F.col("field"), F.col("term"))

    sizes = counts.groupBy(bucket.alias("bucket")).agg(F.ceil(F.sum("df") / rows_per_file).cast("int").alias("slices"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    first = F.coalesce(F.sum("slices").over(before), F.lit(0)).cast("int")
    slices_path = f"{root}/slices/gen={gen}"
    sizes.withColumn("first", first).coalesce(1).write.mode("overwrite").parquet(slices_path)
    slices = _read(spark, "slices", id_type, slices_path).drop("gen")
    tasks = slices.agg(F.sum("slices")).first()[0] or 1
    (
        stats.postings(forward)
        .withColumn("bucket", bucket)
        .join(F.broadcast(slices), "bucket")  # at most MAX_BUCKETS rows
        .withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
        .repartitionById(tasks, F.col("first") + F.col("slice"))
        .drop("slices", "first")
        .sortWithinPartitions("bucket", "field", "term", "doc_id")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{root}/postings/gen={gen}")
    )
    return buckets, counts


def _write_terms(terms: DataFrame, root: str, version: int, buckets: int) -> None:
    (
        terms.withColumn("bucket", bucket_of(buckets, F.col("field"), F.col("term")))
        .repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(16)))
        .sortWithinPartitions("bucket", "field", "term")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{root}/terms/version={version}")
    )


def _read(spark: SparkSession, name: str, id_type: str, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name].format(id=id_type)).parquet(path)


def _write_small(rows: DataFrame, root: str, name: str, version: int) -> DataFrame:
    path = f"{root}/{name}/version={version}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _file_docs(texts_docs: DataFrame, gen: int) -> DataFrame:
    return texts_docs.select("doc_id", F.lit(gen).alias("gen"), "path", "id", "stamp")


def write_index(
    docs: DataFrame,
    texts: DataFrame,
    root: str,
    stop_words=ENGLISH_STOP_WORDS,
    buckets: int | None = None,
    rows_per_file: int = ROWS_PER_FILE,
) -> Index:
    """Build an index from ``docs (doc_id, path, id, stamp)`` and ``texts (doc_id, field, values)``.

    On a root that holds an index already the build becomes its next version; readers of the others keep them.
    """
    spark = docs.sparkSession
    version, gen = next_numbers(spark, root)
    stats.forward_index(texts, stop_words).write.mode("overwrite").parquet(f"{root}/forward/gen={gen}")
    id_type = dict(docs.dtypes)["doc_id"]
    buckets, terms = _write_postings(spark, root, gen, id_type, buckets, rows_per_file)
    _write_terms(terms.select("field", "term", "df"), root, version, buckets)
    live = _write_small(_file_docs(docs, gen), root, "docs", version)
    _write_small(live.select("doc_id", "gen").where(F.lit(False)), root, "removed", version)
    return _publish(Index(spark, root, version, (gen,), buckets, live.count(), 0, id_type, tuple(stop_words)))


def refresh_index(index: Index, docs: DataFrame, texts_of) -> Index:
    """Bring an index up to date with the listing ``docs (doc_id, path, id, stamp)``.

    ``texts_of(changed)`` returns the texts of the new and changed rows only. Documents that are
    gone from the listing are removed. Nothing is written when nothing changed. The texts are cut
    with the index's own stop words. An index that is not the newest version is refused.
    """
    spark, root = index.spark, index.root
    version, gen = _next_of(index)
    states = classify(docs, index.docs().drop("id", "doc_id"), "path")
    todo = written(states.where("state <> 'unchanged'"), "refresh-todo")
    gone = stale(index.docs(), docs, "path")
    replaced = index.docs().join(todo.where("state = 'changed'").select("path"), "path", "left_semi")
    dropped = written(gone.unionByName(replaced).select("doc_id", "gen"), "refresh-dropped")
    n_todo, n_dropped = todo.count(), dropped.count()
    if not n_todo and not n_dropped:
        return index

    # counts of what leaves the index come from the old generations' forward rows
    minus = stats.term_counts(index.forward().join(dropped, ["doc_id", "gen"], "left_semi"))
    parts = [
        index.terms().select("field", "term", "df"),
        minus.select("field", "term", (-F.col("df")).alias("df")),
    ]
    gens = index.gens
    if n_todo:
        fresh = stats.forward_index(texts_of(todo.drop("state")), index.stop_words)
        fresh.write.mode("overwrite").parquet(f"{root}/forward/gen={gen}")
        _, plus = _write_postings(spark, root, gen, index.id_type, index.buckets)
        parts.append(plus.select("field", "term", "df"))
        gens = (*gens, gen)
    terms = parts[0]
    for part in parts[1:]:
        terms = terms.unionByName(part)
    terms = terms.groupBy("field", "term").agg(F.sum("df").alias("df"))
    _write_terms(terms.where("df > 0"), root, version, index.buckets)

    live = index.docs().join(dropped, ["doc_id", "gen"], "left_anti").unionByName(_file_docs(todo, gen))
    live = _write_small(live, root, "docs", version)
    removed = _write_small(index.removed().unionByName(dropped), root, "removed", version)
    return _publish(replace(index, version=version, gens=gens, n_docs=live.count(), n_removed=removed.count()))


def needs_compaction(index: Index, generations: int = 16, removed_share: float = 0.2) -> bool:
    """Whether searches read many generations, or skip a good part of what they read."""
    return len(index.gens) > generations or index.n_removed > removed_share * max(index.n_docs, 1)


def compact_index(index: Index) -> Index:
    """Rewrite the live documents as one generation, so that readers skip nothing.

    The number of buckets is chosen anew, for what the index has grown to.
    """
    spark, root = index.spark, index.root
    version, gen = _next_of(index)
    index.forward().drop("gen").write.mode("overwrite").parquet(f"{root}/forward/gen={gen}")
    buckets, terms = _write_postings(spark, root, gen, index.id_type, None)
    _write_terms(terms.select("field", "term", "df"), root, version, buckets)
    live = _write_small(index.docs().withColumn("gen", F.lit(gen)), root, "docs", version)
    _write_small(live.select("doc_id", "gen").where(F.lit(False)), root, "removed", version)
    return _publish(replace(index, version=version, gens=(gen,), buckets=buckets, n_removed=0))
