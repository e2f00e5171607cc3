import random

import pytest

from letterloom.operators.report import folder_counts, load_report, running_bytes
from letterloom.streaming.load import above_mark, incremental_batch, incremental_load, load_marks, loaded, raise_marks, stored_marks, write_batch

SCHEMA = "folder string, uid bigint, size bigint, expunged boolean"


def frame(spark, rows):
    return spark.createDataFrame([(f, u, u * 10, e) for f, u, e in rows], SCHEMA)


def keys(rows):
    got = [(r.folder, r.uid) for r in rows.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_three_runs_over_two_drops(spark, tmp_path):
    root, drops = str(tmp_path / "stored"), str(tmp_path / "drops")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{drops}/*")
        query = incremental_load(stream, root, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return query

    first = [("a", u, False) for u in range(100)] + [("b", u, False) for u in range(0, 50, 2)]
    frame(spark, first).write.parquet(f"{drops}/1")
    run()
    assert keys(loaded(spark, root)) == {(f, u) for f, u, _ in first}
    # new rows, one twice; stored rows again; a row below the mark that never came; deletions, one ahead of its row
    second = [("a", 100, False), ("a", 100, False), ("c", 1, False), ("a", 5, False), ("b", 3, False), ("a", 7, True), ("a", 200, True)]
    frame(spark, second).write.parquet(f"{drops}/2")
    run()
    want = {(f, u) for f, u, _ in first} | {("a", 100), ("c", 1), ("b", 3)}
    assert keys(loaded(spark, root)) == want - {("a", 7)}
    assert {(r.folder, r.last_uid) for r in stored_marks(spark, root).collect()} == {("a", 100), ("b", 48), ("c", 1)}
    frame(spark, [("a", 200, False)]).write.parquet(f"{drops}/3")
    run()
    assert keys(loaded(spark, root)) == want - {("a", 7)}
    assert not run().recentProgress or run().recentProgress[-1]["numInputRows"] == 0


def test_a_replayed_batch_stores_the_same_rows(spark, tmp_path):
    root = str(tmp_path)
    one = frame(spark, [("a", u, False) for u in range(10)])
    two = frame(spark, [("a", u, False) for u in range(5, 15)])
    write_batch(one, 0, root)
    write_batch(two, 1, root)
    write_batch(two, 1, root)
    write_batch(one, 0, root)
    assert keys(loaded(spark, root)) == {("a", u) for u in range(15)}
    assert spark.read.parquet(f"{root}/messages").count() == 15


def test_incremental_batch(spark):
    source = frame(spark, [("a", u, False) for u in range(10)] + [("b", 1, False)])
    stored = source.where("folder = 'a' and uid <= 6 and uid <> 3")
    assert keys(incremental_batch(source, load_marks(stored), stored)) == {("a", 3), ("a", 7), ("a", 8), ("a", 9), ("b", 1)}
    fresh = source.where("uid > 6")
    assert keys(incremental_batch(fresh, load_marks(stored), stored)) == {("a", 7), ("a", 8), ("a", 9)}


def test_marks_never_fall(spark):
    old = spark.createDataFrame([("a", 9), ("b", 1)], "folder string, last_uid bigint")
    new = spark.createDataFrame([("a", 5), ("b", 2), ("c", 3)], "folder string, last_uid bigint")
    assert {(r.folder, r.last_uid) for r in raise_marks(old, new).collect()} == {("a", 9), ("b", 2), ("c", 3)}


def test_the_mark_is_pushed_to_the_scan(spark, tmp_path):
    frame(spark, [("a", 1, False)]).write.parquet(str(tmp_path / "t"))
    plan = above_mark(spark.read.parquet(str(tmp_path / "t")), 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(uid,5)" in plan


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_running_bytes(spark, block):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), uid * 10**9, rng.randrange(1000)) for uid in range(500)]
    got = running_bytes(spark.createDataFrame(rows, "folder string, uid bigint, size bigint"), block).collect()
    sums, want = {}, set()
    for folder, uid, size in rows:
        sums[folder] = sums.get(folder, 0) + size
        want.add((folder, uid, size, sums[folder]))
    assert {tuple(r) for r in got} == want and len(got) == 500


def test_reports(spark):
    rows = frame(spark, [("a", 100, False), ("a", 200, False), ("b", 1, False)])
    assert {tuple(r) for r in load_report(rows).collect()} == {("a", 2, 3000, "2.9 KiB"), ("b", 1, 10, "10 B")}
    folders = spark.createDataFrame([("a", "A", True), ("b", "B", False), ("c", "C", True)], "full_name string, name string, holds_messages boolean")
    assert {tuple(r) for r in folder_counts(folders, rows).collect()} == {("a", "A", 2), ("c", "C", 0)}
