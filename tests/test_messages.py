import datetime
import re
import tracemalloc
from email.header import Header
from email.mime.image import MIMEImage
from email.mime.message import MIMEMessage
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

import pyarrow as pa
import pytest

from letterloom.operators.search import as_clauses, fetch, result_view, search
from letterloom.plans.index import write_index
from letterloom.functions import mime
from letterloom.sources import messages as sources
from letterloom.sources.files import listing, scan_files
from letterloom.sources.messages import header_lines, ingest_messages, message_docs, message_texts, rejects
from tests.plain_mime import parse_message


def simple(kind, text, subject="s"):
    return f"Subject: {subject}\r\nFrom: Ann <ann@example.org>, bob@example.org\r\nContent-Type: {kind}; charset=utf-8\r\n\r\n{text}".encode()


def multipart(*parts, kind="mixed"):
    message = MIMEMultipart(kind)
    for part in parts:
        message.attach(part)
    return message


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("mail")
    seven = multipart(MIMEText("plain words", "plain", "utf-8"), MIMEText("<p>html words</p>", "html", "utf-8"), MIMEImage(b"x", "png"))
    inner = multipart(MIMEText("inner plain", "plain", "utf-8"), MIMEText("<b>inner html</b>", "html", "utf-8"), kind="alternative")
    eight = multipart(MIMEText("outer", "plain", "utf-8"), inner)
    nine = (
        b"Received: by one\r\nReceived: by two\r\nSubject: =?utf-8?B?w6lsw6ltZW50?=\r\nDate: Mon, 01 Jan 2024 12:00:00 +0200\r\n"
        b"Content-Type: text/plain\r\n\r\nnine\r\n"
    )
    files = {
        "a/1.eml": simple("text/plain", "first body"),
        "b/1.eml": simple("text/plain", "second body"),
        "a/2.EML": simple("text/plain", "upper"),
        "x.eml/3.eml": simple("text/plain", "three"),
        "a/empty.eml": b"",
        "a/4.eml": simple("text/plain", "<p>kept as it is</p>"),
        "a/5.eml": simple("text/html", "<p>kept <b>te</b>xt</p>"),
        "a/6.eml": simple("text/calendar", "BEGIN:VCALENDAR"),
        "a/7.eml": seven.as_bytes(),
        "a/8.eml": eight.as_bytes(),
        "a/9.eml": nine,
        "a/10.eml": b"Subject: x\r\nContent-Type: text/plain; charset=no-such-set\r\n\r\nabc",
        "a/11.eml": b"\x00\x01\x02 no message at all",
    }
    for name, content in files.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


@pytest.fixture(scope="module")
def messages(spark, root):
    return ingest_messages(scan_files(spark, root, ".eml", ignore_case=False)).cache()


def texts(messages, name, **options):
    rows = message_texts(messages, **options).collect()
    return {r.field: r["values"] for r in rows if r.doc_id.endswith(name)}


def test_every_file_is_a_row(messages):
    names = sorted(r.path.split("/", 1)[1].split("mail", 1)[1].split("/", 1)[1] for r in messages.collect())
    assert len(names) == 11 and "a/2.EML" not in names and "a/empty.eml" not in names


def test_equal_names_are_two_documents(messages):
    docs = message_docs(messages).where("id = '1.eml'").collect()
    assert len({d.doc_id for d in docs}) == 2


def test_bodies_follow_the_content_type(messages):
    assert texts(messages, "a/4.eml")["body"] == ["<p>kept as it is</p>"]
    assert texts(messages, "a/5.eml")["body"] == ["kept text"]
    six = texts(messages, "a/6.eml")
    assert six["body"] == [""] and six["Subject"] == ["s"] and "body_all" not in six


def test_parts(messages):
    seven = texts(messages, "a/7.eml")
    assert [seven[f"body-{i}"] for i in range(3)] == [["plain words"], ["html words"], [""]]
    assert seven["body_all"] == ["plain words", "html words"]
    assert "body-0" not in texts(messages, "a/7.eml", per_part=False)


def test_nested_parts_are_flattened_unless_depth_is_one(spark, root, messages):
    eight = texts(messages, "a/8.eml")
    assert eight["body_all"] == ["outer", "inner plain", "inner html"]
    flat = ingest_messages(scan_files(spark, root, "8.eml"), depth=1)
    assert texts(flat, "a/8.eml")["body_all"] == ["outer"]
    assert texts(flat, "a/8.eml")["body-1"] == [""]


def test_headers_are_kept_in_order_and_decoded(messages):
    row = messages.where("path like '%a/9.eml'").first()
    assert [h.value for h in row.headers if h.name == "Received"] == ["by one", "by two"]
    assert row.subject == "élément" and str(row.sent) == "2024-01-01 10:00:00"
    assert texts(messages, "a/9.eml")["Received"] == ["by one", "by two"]
    lines = header_lines(messages.where("path like '%a/9.eml'")).orderBy("idx").collect()
    assert [x.line for x in lines][:3] == ["Received: by one", "Received: by two", "Subject: élément"]


def test_bad_files_are_rows_with_an_error(messages):
    bad = {r.path.rsplit("/", 1)[-1]: r.error for r in rejects(messages).collect()}
    assert bad.keys() == {"11.eml"}


def read(spark, contents):
    """Messages of the given bytes, with what the standard library reads of each."""
    rows = [(f"m/{i}", datetime.datetime(2024, 1, 1), len(c), bytearray(c)) for i, c in enumerate(contents)]
    files = spark.createDataFrame(rows, "path string, modificationTime timestamp, length bigint, content binary")
    got = {int(r.id): r for r in ingest_messages(files).collect()}
    return [(got[i], parse_message(c)) for i, c in enumerate(contents)]


def test_bad_bytes_cost_no_message(spark):
    def of(kind, data):
        return b"Subject: x\r\nContent-Type: " + kind + b"\r\n\r\n" + data

    cases = {
        of(b"text/plain; charset=us-ascii", "caf\u00e9 au lait".encode("latin-1")): "caf\ufffd au lait",
        of(b"text/plain", b"caf\xe9"): "caf\ufffd",
        of(b"text/plain", "caf\u00e9".encode()): "caf\u00e9",
        of(b"text/plain; charset=no-such-set", b"abc"): "abc",
        of(b"text/csv; charset=no-such-set", b"a,b"): "",
    }
    for (got, plain), want in zip(read(spark, list(cases)), cases.values(), strict=True):
        assert got.parts[0].text == plain["parts"][0]["text"] == want


def test_messages_are_read_as_the_standard_library_reads_them(spark):
    deep = multipart(multipart(MIMEText("a", "plain", "utf-8"), multipart(MIMEText("<i>b</i>", "html", "latin-1"), MIMEText("c\n--=x\n", "plain", "us-ascii"))), MIMEText("d", "plain", "utf-8"))
    inner = MIMEMessage(MIMEText("inside", "plain", "utf-8"))
    long = MIMEText("x", "plain", "utf-8")
    long["Subject"] = Header("Grüße aus einer sehr langen Zeile, die umgebrochen werden muss, weil sie länger ist als erlaubt", "utf-8")
    long["From"] = '"Doe, J" <j@example.org>, plain@example.org, <only@example.org>'
    long["Date"] = "1 Feb 24 09:05 EST"
    quoted = b"Subject: q\nContent-Transfer-Encoding: Quoted-Printable\nContent-Type: text/plain; charset=\"iso-8859-1\"\n\ncaf=E9 is=\n one=20word\n"
    contents = [m.as_bytes() for m in (deep, multipart(inner, MIMEText("after")), long)] + [
        quoted,
        quoted.replace(b"\n", b"\r\n"),
        b"Subject: no body",
        b"Subject: folded\n  over\n\tlines\nX-Empty:\n\nbody\n\nwith blank lines\n",
        b"From me@example.org Mon Jan  1 00:00:00 2024\nSubject: box\n\nbody",
        b"Subject: x\nthis line is no header\nTo: y\n\nbody",
        b"Content-Type: multipart/mixed; boundary=b\n\npreamble\n--b\n\nno headers\n--b  \nContent-Type: text/html\n\n<p>h</p>\n--b--\nepilogue",
        b"Content-Type: multipart/mixed; boundary=b\n\nno bound at all",
        b"Content-Type: multipart/mixed\n\n--b\n\nx\n--b--",
        b"Content-Type: multipart/mixed; boundary=\"a.*[b\"\n\n--a.*[b\n\none\n--a.*[bc\nstill one\n--a.*[b\n\ntwo",
        b"Subject: =?iso-8859-1?Q?caf=E9_au?= =?iso-8859-1?Q?_lait?= and =?no-such?Q?x?=\n\nx",
        b"Subject: =?utf-8?B?w6k=?= plain =?utf-8?q?=C3=A8?=\nDate: Tue, 2 Jan 2024 03:04:05 -0000 (UTC)\n\nx",
        b"Subject: x\nDate: yesterday\nFrom: ann@example.org (Ann)\nContent-Transfer-Encoding: base64\n\nw6l0w6k=\n",
    ]
    for got, plain in read(spark, contents):
        unfolded = [(h["name"], re.sub(r"\n(?=[ \t])", "", h["value"])) for h in plain["headers"]]
        assert [(h.name, h.value) for h in got.headers] == unfolded
        assert [(p.idx, p.content_type, p.text) for p in got.parts] == [(p["idx"], p["content_type"], p["text"]) for p in plain["parts"]]
        assert got["from"] == plain["from"] and got.multipart == plain["multipart"] and got.error is None
        sent = plain["sent"]
        if sent is not None:
            sent = (sent if sent.tzinfo is None else sent.astimezone(datetime.UTC)).replace(tzinfo=None)
        assert got.sent == sent


def test_deep_nesting_is_opened_up_to_a_bound(spark):
    message = MIMEText("innermost", "plain", "utf-8")
    for _ in range(mime.MOST_NESTED - 1):
        message = multipart(message)
    (got, plain), = read(spark, [message.as_bytes()])
    assert [p.text for p in got.parts] == [p["text"] for p in plain["parts"]] == ["innermost"]


def test_from_files_to_results(spark, root, messages, tmp_path):
    index = write_index(message_docs(messages), message_texts(messages), str(tmp_path / "index"))
    clauses = as_clauses(spark.createDataFrame([(1, "body"), (2, "words"), (3, "kept"), (4, "the")], "query_id bigint, term string"))
    hits = search(index, clauses, kinds=("term",))
    found = {(r.query_id, r.doc_id.rsplit("/", 2)[-2] + "/" + r.doc_id.rsplit("/", 1)[-1]) for r in hits.collect()}
    assert found == {(1, "a/1.eml"), (1, "b/1.eml"), (2, "a/7.eml"), (3, "a/4.eml"), (3, "a/5.eml")}
    phrase = as_clauses(spark.createDataFrame([(1, "words html"), (2, "plain words")], "query_id bigint, term string"), kind="phrase")
    assert [r.query_id for r in search(index, phrase, kinds=("phrase",)).collect()] == [2]
    shown = result_view(hits, messages.withColumnRenamed("path", "doc_id").selectExpr("*", "doc_id as path"))
    row = shown.where("query_id = 3").first()
    assert row.sender == "Ann <ann@example.org>; bob@example.org" and row.link.startswith("?file=file%3A")
    paths = [(messages.first().path,), ("/none",)]
    got = fetch(spark.createDataFrame(paths, "path string"), messages).select("path", "status").collect()
    assert sorted(r.status for r in got) == ["found", "missing"]


def test_listing_reads_no_contents(spark, root):
    files = listing(scan_files(spark, root, ".eml"))
    assert files.columns == ["path", "id", "stamp", "size"]
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1]


def undecoded(rows):
    """A batch as it reaches Python: of each message the header values and the signs of its parts."""
    headers = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    parts = pa.list_(pa.struct([("idx", pa.int32()), ("content_type", pa.string()), ("encoding", pa.string()), ("charset", pa.string()), ("raw", pa.string())]))
    named = [None if values is None else [{"name": "Subject", "value": v} for v in values] for values, _ in rows]
    whole = [None if raws is None else [{"idx": i, "content_type": "text/html", "encoding": "", "charset": "utf-8", "raw": r} for i, r in enumerate(raws)] for _, raws in rows]
    n = len(rows)
    columns = [pa.array([f"m/{i}" for i in range(n)]), pa.array([f"{i}" for i in range(n)]), *[pa.array([0] * n, pa.int64())] * 2, pa.array(named, headers), pa.array([False] * n), pa.array(whole, parts)]
    return pa.RecordBatch.from_arrays(columns, ["path", "id", "stamp", "size", "headers", "multipart", "parts"])


def test_a_large_batch_is_decoded_a_little_at_a_time():
    sign = "é".encode().decode("latin-1")
    batch = undecoded([([f"s{i}"], ["url", sign * 200_000]) for i in range(60)])  # 400,000 signs each, 800 kB in Arrow
    tracemalloc.start()
    try:
        rows, chars = 0, 0
        for out in sources._decoded(iter([batch])):
            rows += out.num_rows
            chars += sum(len(t) for t in out.column("parts").flatten().field("text").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (rows, chars) == (60, 60 * 200_003)
    assert peak < 10_000_000


def test_runs_of_any_size_decode_the_same(monkeypatch):
    rows = [(["a"], ["x" * 50, None]), (None, None), ([], []), (["=?utf-8?Q?b=C3=A9?="], [None]), (["c" * 500], ["y"]), ([""], ["", "z" * 3, "w" * 900]), (["d"], [])]
    batch = undecoded(rows * 3).slice(2, 17)
    whole = pa.Table.from_batches(sources._decoded(iter([batch]))).to_pylist()
    assert [r["path"] for r in whole] == [f"m/{i}" for i in range(2, 19)]
    for most in (0, 1, 60, 1000):
        monkeypatch.setattr(sources, "DECODED_TOGETHER", most)
        runs = [*sources._decoded(iter([batch, batch.slice(0, 0)]))]
        assert pa.Table.from_batches(runs).to_pylist() == whole
        assert len(runs) > 1
