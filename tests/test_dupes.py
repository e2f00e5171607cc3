import collections
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from letterloom.functions.bytes import prefix_hash
from letterloom.operators.dupes import dup_groups, dup_members
from letterloom.sources.files import oldest_first, outermost, scan_files


@pytest.fixture(scope="module")
def texts(spark):
    """A third of all rows hold the same text."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else f"text {rng.randrange(150)}") for i in range(300)]
    rows += [(1000, ""), (1001, "")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").cache()


@pytest.mark.parametrize("algorithm", ["md5", "crc32", "adler32", "fast64"])
@pytest.mark.parametrize("hot_rows", [10, 100_000])
def test_members_equal_brute_force(spark, texts, algorithm, hot_rows):
    rows, frame = texts
    groups = collections.defaultdict(list)
    for key, text in rows:
        if text:
            groups[text].append(key)
    want = {(k, len(g), min(g)) for g in groups.values() if len(g) > 1 for k in g}
    got = dup_members(frame, "doc_id", content="text", algorithm=algorithm, hot_rows=hot_rows).collect()
    assert {(r.doc_id, r.n, r.first_key) for r in got} == want and len(got) == len(want)


def test_groups_summarise_members(spark, texts):
    _, frame = texts
    members = dup_members(frame, "doc_id", content="text", algorithm="md5")
    sizes = {r.hash: r["count"] for r in members.groupBy("hash").count().collect()}
    assert {r.hash: r.n for r in dup_groups(frame, "doc_id", content="text", algorithm="md5").collect()} == sizes


@pytest.mark.parametrize("algorithm", ["md5", "adler32"])
def test_contents_are_read_once(spark, texts, tmp_path, algorithm):
    texts[1].write.parquet(str(tmp_path / "t"))
    frame = dup_members(spark.read.parquet(str(tmp_path / "t")), "doc_id", content="text", algorithm=algorithm)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==\n   Project")[0]
    rows = plan.split("Subquery")[0]
    assert rows.count("FileScan") == 1 and "ReusedExchange" in plan
    assert plan.split("FileScan")[0].count("ArrowEvalPython") == (algorithm == "adler32")


def test_adler32_is_the_standard_checksum(spark):
    data = b"abc" * 1000
    got = spark.createDataFrame([(data,)], "c binary").select(prefix_hash(F.col("c"), "adler32").alias("h")).first().h
    assert got == zlib.adler32(data)


def test_unknown_hash(spark):
    with pytest.raises(ValueError):
        prefix_hash(F.col("c"), "sha0")


def test_the_first_mebibyte_counts_only_where_it_is_asked_for(spark, tmp_path):
    head = bytes(1 << 20)
    (tmp_path / "11.bin").write_bytes(head + b"a")
    (tmp_path / "12.bin").write_bytes(head + b"b")
    (tmp_path / "empty.bin").write_bytes(b"")
    files = scan_files(spark, str(tmp_path), "bin")
    assert [r.n for r in dup_groups(files, "path", prefix_bytes=1 << 20, verify=False).collect()] == [2]
    assert dup_groups(files, "path", prefix_bytes=1 << 20).count() == dup_groups(files, "path").count() == 0


def test_scan_finds_by_suffix_and_skips_missing_roots(spark, tmp_path):
    for name in ["a/1.eml", "a/2.EML", "x.eml/3.eml", "a/foo.txt", "a/footxt"]:
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    root = str(tmp_path)

    def names(*args, **kw):
        return sorted(r.path.rsplit("/", 1)[-1] for r in scan_files(spark, *args, **kw).select("path").collect())

    assert names(root, ".eml", ignore_case=False) == ["1.eml", "3.eml"]
    assert names(root, ".eml") == ["1.eml", "2.EML", "3.eml"]
    assert names(root, "txt") == ["foo.txt", "footxt"]
    assert names([root, root + "/a", root + "/none"], "txt") == ["foo.txt", "footxt"]
    assert len(names(root)) == 5
    assert names(root + "/none") == []


def test_outermost():
    assert outermost(["/a/b", "/a", "/ab", "/a/"]) == ["/a", "/ab"]


def test_oldest_first(spark, tmp_path):
    for n, stamp in (("a", 300), ("b", 100), ("c", 200)):
        (tmp_path / n).write_bytes(b"x")
        os.utime(tmp_path / n, (stamp, stamp))
    assert [r.path[-1] for r in oldest_first(scan_files(spark, str(tmp_path))).select("path").collect()] == ["b", "c", "a"]


def test_texts_that_differ_late_or_share_a_checksum_are_no_duplicates(spark):
    """Equal in their first MiB, or of one crc32: only whole contents decide, unless the hash alone is asked for."""
    head = "x" * (1 << 20)
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "a"), (4, "plumless"), (5, "buckeroo")]
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for algorithm in ("adler32", "crc32", "fast64", "md5"):
        got = dup_members(frame, "doc_id", content="text", algorithm=algorithm).collect()
        assert sorted((r.doc_id, r.first_key) for r in got) == [(1, 1), (3, 1)]
    first = dup_members(frame, "doc_id", content="text", algorithm="md5", prefix_bytes=1 << 20, verify=False).collect()
    assert sorted(r.doc_id for r in first) == [1, 2, 3]
    alone = dup_members(frame, "doc_id", content="text", algorithm="crc32", verify=False).collect()
    assert sorted(r.doc_id for r in alone) == [1, 3, 4, 5]
