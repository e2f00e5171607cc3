import re

from pyspark.sql import functions as F

from letterloom.operators.dupes import staged_members
from letterloom.operators.lookup import fetch_laid_out, lay_out
from letterloom.session import new_folder, own_folder, passing_tables, written


def test_few_messages_are_read_from_their_parts(spark, tmp_path):
    messages = spark.range(5000).select(F.concat(F.lit("m/"), "id").alias("path"), F.col("id").alias("size"))
    lay_out(messages, str(tmp_path / "laid"), parts=64)
    requests = spark.createDataFrame([("m/7",), ("m/4999",), ("m/none",)], "path string")
    found = fetch_laid_out(requests, str(tmp_path / "laid"), parts=64)
    assert {tuple(r) for r in found.select("path", "size", "status").collect()} == {("m/7", 7, "found"), ("m/4999", 4999, "found"), ("m/none", None, "missing")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    parts = re.search(r"PartitionFilters: \[[^\]]*part#\d+ IN \(([\d,]+)\)", plan)[1]
    assert len(parts.split(",")) <= 3
    assert fetch_laid_out(requests.limit(0), str(tmp_path / "laid"), parts=64).isEmpty()


def test_staged_members_ask_for_less_and_less(spark):
    texts = {1: "abc", 2: "abd", 3: "abc", 4: "unique length", 5: "", 6: None, 7: "xyz", 8: "xyz", 9: "xyw"}
    rows = spark.createDataFrame(list(texts.items()), "key int, content string")
    asked = []

    def contents_of(wanted):
        asked.append({r.key for r in wanted.collect()})
        return rows.join(wanted, "key", "left_semi")

    found = staged_members(rows.select("key", F.length("content").alias("size")), contents_of, "key", prefix_bytes=2).collect()
    assert {(r.key, r.n, r.first_key) for r in found} == {(1, 2, 1), (3, 2, 1), (7, 2, 7), (8, 2, 7)}
    assert asked == [{1, 2, 3, 7, 8, 9}, {1, 2, 3, 7, 8, 9}]
    whole = staged_members(rows.select("key", F.length("content").alias("size")), contents_of, "key").collect()
    assert len(whole) == 4 and asked[-1] == {1, 3, 7, 8}


def test_passing_tables_go_at_the_end(spark):
    kept = written(spark.range(3), "kept")
    with passing_tables(spark):
        inner = written(spark.range(4), "inner")
        with passing_tables(spark):
            assert written(spark.range(5), "innermost").count() == 5
        assert inner.count() == 4
    assert kept.count() == 3
    assert not [f for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(own_folder(spark)).select("path").collect() if "passing-" in f.path]
    assert "passing" not in new_folder(spark, "x")
