import pytest
from pyspark.sql import functions as F

from letterloom.operators.refresh import apply_tombstones, classify, kept, newest, stale, upsert
from letterloom.plans.index import compact_index, needs_compaction, open_index, refresh_index, write_index
from letterloom.plans.queries import document_listing, document_texts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").cache()


def build(docs, documents, root, **options):
    texts = document_texts(documents).join(docs.select("doc_id"), "doc_id", "left_semi")
    return write_index(docs, texts, root, stop_words=(), **options)


def snapshots(documents):
    """The derived listings of the fixtures: some documents gone, some new, some with a later stamp."""
    docs = document_listing(documents)
    old = docs.where("doc_id % 5 <> 0")
    new = docs.where("doc_id % 11 <> 0").withColumn("stamp", F.expr("stamp + if(doc_id % 7 = 0, 1, 0)"))
    return old, new


def content(index):
    terms = {(r.field, r.term, r.df) for r in index.terms().collect()}
    rows = {(r.field, r.term, r.doc_id, r.tf, tuple(r.pos), r.len) for r in index.postings().collect()}
    docs = {(r.doc_id, r.path, r.stamp) for r in index.docs().collect()}
    lens = {(r.field, r.doc_id, r.len) for r in index.doc_len().collect()}
    return terms, rows, docs, lens, index.n_docs


def texts_of(documents):
    return lambda changed: document_texts(documents).join(changed.select("doc_id"), "doc_id", "left_semi")


def test_counts_of_the_derived_snapshots(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old, new = snapshots(documents)
    states = {r.state: r["count"] for r in classify(new, old).groupBy("state").count().collect()}
    assert states == {"new": 181, "changed": 104, "unchanged": 624}
    assert stale(old, new).count() == 72
    assert kept(old, new).count() == 800 - 72
    fresh = classify(new, old).where("state <> 'unchanged'").drop("state")
    assert upsert(old, fresh).count() == 800 + 181


def test_refresh_equals_rebuild_and_keeps_old_versions(spark, documents, tmp_path):
    old, new = snapshots(documents)
    first = build(old, documents, str(tmp_path / "a"), rows_per_file=500)
    before = content(first)
    second = refresh_index(first, new, texts_of(documents))
    rebuilt = build(new, documents, str(tmp_path / "b"), buckets=3)
    assert content(second) == content(rebuilt)
    assert content(open_index(spark, first.root, 1)) == before
    assert open_index(spark, first.root).version == 2

    unchanged = refresh_index(second, new, texts_of(documents))
    assert unchanged == second and open_index(spark, first.root).version == 2

    compacted = compact_index(second)
    assert content(compacted) == content(second) and compacted.n_removed == 0

    third = refresh_index(compacted, old, texts_of(documents))
    assert content(third)[1] == before[1] and content(third)[0] == before[0]


def test_refresh_from_an_empty_index(spark, documents, tmp_path):
    _, new = snapshots(documents)
    index = build(new.where("false"), documents, str(tmp_path / "a"))
    assert index.n_docs == 0
    assert content(refresh_index(index, new, texts_of(documents))) == content(build(new, documents, str(tmp_path / "b")))


def test_everything_removed(spark, documents, tmp_path):
    _, new = snapshots(documents)
    index = build(new, documents, str(tmp_path / "a"))
    emptied = refresh_index(index, new.where("false"), texts_of(documents))
    assert content(emptied) == (set(), set(), set(), set(), 0)


def test_a_hot_term_is_cut_into_slices(spark, tmp_path):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.col("id").cast("string").alias("path"), F.lit("x").alias("id"), F.lit(1).cast("bigint").alias("stamp")
    )
    texts = docs.select("doc_id", F.lit("body").alias("field"), F.array(F.concat(F.lit("hot w"), "path")).alias("values"))
    index = write_index(docs, texts, str(tmp_path / "i"), (), rows_per_file=50)
    hot = index.postings().where("term = 'hot'")
    spread = {r["slice"]: r["count"] for r in hot.groupBy("slice").count().collect()}
    assert len(spread) >= 8 and sum(spread.values()) == 400
    files = index.postings().groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert files < 150
    bucket = hot.first().bucket
    assert index.slices().where(F.col("bucket") == bucket).first().slices == len(spread)


def test_newest_and_tombstones(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c"), (1, 3, "aa")], "k int, stamp int, v string")
    assert {(r.k, r.v) for r in newest(rows, "k", "stamp", "v").collect()} == {(1, "aa"), (2, "c")}
    assert apply_tombstones(rows, rows.where("k = 1"), "k").count() == 1


def test_writers_start_from_the_newest_version(spark, documents, tmp_path):
    """An old handle is refused, a rebuild takes fresh numbers, and a reader keeps what it opened."""
    old, new = snapshots(documents)
    root = str(tmp_path / "a")
    first = build(old, documents, root)
    before = content(first)
    second = refresh_index(first, new, texts_of(documents))
    with pytest.raises(ValueError, match="not the newest"):
        refresh_index(first, new, texts_of(documents))
    with pytest.raises(ValueError, match="not the newest"):
        compact_index(first)
    rebuilt = build(old, documents, root)
    assert rebuilt.version == second.version + 1 and min(rebuilt.gens) > max(second.gens)
    assert content(first) == before == content(rebuilt)
    assert open_index(spark, root) == rebuilt and open_index(spark, root, second.version) == second
    assert needs_compaction(second, generations=1) and not needs_compaction(rebuilt)


def test_a_task_writes_no_more_than_a_file_of_postings(spark, tmp_path):
    """At 200 words a document a gigabyte of texts has 100 million postings and 8 buckets: more than a task should sort."""
    from letterloom.plans import index as plan

    assert 100_000_000 // plan.MIN_BUCKETS // plan.ROWS_PER_FILE >= 4
    rows = spark.range(300).selectExpr("id as doc_id", "'body' as field", "array(concat('common w', id)) as values")
    listing = rows.selectExpr("doc_id", "cast(doc_id as string) as path", "'x' as id", "1L as stamp")
    index = plan.write_index(listing, rows, str(tmp_path / "cut"), stop_words=(), rows_per_file=20)
    slices = index.raw_postings().where("term = 'common'").groupBy("slice").count().collect()
    assert sum(r["count"] for r in slices) == 300 and max(r["count"] for r in slices) < 60
