import os
import re
from urllib.parse import unquote_plus

from letterloom.operators.search import as_clauses, query_words
from letterloom.plans.index import compact_index, open_index
from letterloom.plans.mail import index_mail, mail_messages, mail_rejects, refresh_mail, search_mail
from letterloom.sources.files import FILES_PER_FOLDER, TASKS_PER_CORE, scan_files, write_files
from letterloom.sources.pages import file_text


def put(root, name, text, stamp, kind="text/plain; charset=utf-8"):
    path = root / name
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(f"Subject: {name}\r\nContent-Type: {kind}\r\n\r\n{text}".encode())
    os.utime(path, (stamp, stamp))


def subjects(spark, index, word):
    clauses = as_clauses(spark.createDataFrame([(1, word)], "query_id bigint, term string"))
    rows = search_mail(index, clauses, kinds=("term",), occurs=("should",)).collect()
    return sorted(r.subject for r in rows)


def test_mail_folder_is_followed(spark, tmp_path):
    mail, root = tmp_path / "mail", str(tmp_path / "index")
    mail.mkdir()
    for n in range(6):
        put(mail, f"a/{n}.eml", f"common word{n}", 1_700_000_000 + n)
    index = index_mail(spark, str(mail), root)
    assert subjects(spark, index, "common") == [f"a/{n}.eml" for n in range(6)]
    assert refresh_mail(index, str(mail)) == index

    put(mail, "a/1.eml", "common other", 1_700_001_000)
    put(mail, "b/1.eml", "common fresh", 1_600_000_000)
    for name in ("b/bad.eml", "a/2.eml"):
        (mail / name).write_bytes(b"\r\nno headers, so no message\r\n")
        os.utime(mail / name, (1_700_001_000, 1_700_001_000))
    (mail / "a/3.eml").unlink()
    second = refresh_mail(index, str(mail))
    assert subjects(spark, second, "common") == ["a/0.eml", "a/1.eml", "a/2.eml", "a/4.eml", "a/5.eml", "b/1.eml"]
    assert subjects(spark, second, "other") == ["a/1.eml"]
    assert subjects(spark, second, "word1") == [] and subjects(spark, second, "word3") == []
    assert subjects(spark, second, "word2") == ["a/2.eml"]
    assert sorted(r.id for r in mail_rejects(second).collect()) == ["2.eml", "bad.eml"]
    assert mail_messages(second).count() == 6 == second.n_docs
    assert subjects(spark, open_index(spark, root, 1), "word3") == ["a/3.eml"]

    put(mail, "a/2.eml", "common mended", 1_700_002_000)
    third = refresh_mail(second, str(mail))
    assert subjects(spark, third, "mended") == ["a/2.eml"] and subjects(spark, third, "word2") == []

    small = compact_index(third)
    assert subjects(spark, small, "common") == subjects(spark, third, "common")
    put(mail, "b/1.eml", "common again", 1_700_003_000)
    fourth = refresh_mail(small, str(mail))
    assert subjects(spark, fourth, "again") == ["b/1.eml"] and subjects(spark, fourth, "fresh") == []
    assert subjects(spark, small, "fresh") == ["b/1.eml"] and mail_messages(fourth).count() == 6


def test_words_and_phrases_with_stop_words(spark, tmp_path):
    mail = tmp_path / "mail"
    mail.mkdir()
    put(mail, "a/1.eml", "a letter to the editor of this paper", 1_700_000_000)
    put(mail, "a/2.eml", "the editor wrote no letter", 1_700_000_000)
    index = open_index(spark, index_mail(spark, str(mail), str(tmp_path / "index")).root)
    batch = spark.createDataFrame([(1, "letter to the editor")], "query_id bigint, text string")

    def found(clauses, **options):
        return [(r.subject, r.score) for r in search_mail(index, clauses, **options).orderBy("rank").collect()]

    must = found(query_words(batch, occur="must"), kinds=("term",), occurs=("must",))
    assert sorted(s for s, _ in must) == ["a/1.eml", "a/2.eml"]
    plain = spark.createDataFrame([(1, "letter editor")], "query_id bigint, text string")
    assert found(query_words(batch), kinds=("term",), occurs=("should",)) == found(query_words(plain), kinds=("term",), occurs=("should",))
    phrase = lambda text: as_clauses(spark.createDataFrame([(1, text)], "query_id bigint, term string"), kind="phrase")
    assert [s for s, _ in found(phrase("letter to the editor"), kinds=("phrase",), occurs=("should",))] == ["a/1.eml"]
    assert found(phrase("letter editor"), kinds=("phrase",), occurs=("should",)) == []
    assert found(phrase("to the"), kinds=("phrase",), occurs=("should",)) == []


def test_saved_pages(spark, tmp_path):
    (tmp_path / "p.txt").write_text("<p>one &amp; two</p>")
    assert [r.text for r in file_text(scan_files(spark, str(tmp_path), "txt")).collect()] == ["one & two"]


def test_many_small_files_are_few_tasks(spark, tmp_path):
    """A file that fills a partition by itself is not a task of its own."""
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for n in range(tasks + 8):
        put(tmp_path, f"a/{n}.eml", f"word{n}", 1_700_000_000 + n)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        files = scan_files(spark, str(tmp_path), ".eml")
        assert files.rdd.getNumPartitions() == tasks and len({r.path for r in files.select("path").collect()}) == tasks + 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rows_become_files_in_few_folders(spark, tmp_path):
    """A file for each folder and name of a task, whatever they hold; a folder for each file would be a task each when they are listed."""
    rows = [(f"s{n % 2}", n, f"text {n}") for n in range(600)] + [("a/b %", 1, "été"), (None, 2, None), ("s0", 0, "again")]
    df = spark.createDataFrame(rows, "source string, doc_id bigint, value string").coalesce(1)
    write_files(df, f"{tmp_path}/mail", "source", "doc_id")
    found = {r.path: bytes(r.content).decode() for r in scan_files(spark, f"{tmp_path}/mail", ".TXT").collect()}
    by_name = {}
    for path, text in found.items():
        folder, name = re.search(r"/source=([^/]*)/[^/]*/doc_id=([0-9]+)\.txt$", path).groups()
        by_name[None if folder.startswith("__HIVE") else unquote_plus(folder), int(name)] = text
    want = {(s, n): f"{t or ''}\n" for s, n, t in rows[:-1]} | {("s0", 0): "text 0\nagain\n"}
    assert by_name == want
    assert len({path.rpartition("/")[0] for path in found}) == 2 * -(-300 // FILES_PER_FOLDER) + 2
    assert not [f for d in os.walk(tmp_path) for f in d[2] if not f.endswith(".txt")]
