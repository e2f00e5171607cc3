from pyspark.sql import functions as F

from letterloom.functions.bytes import format_bytes
from letterloom.functions.text import ENGLISH_STOP_WORDS, body_text, html_to_text, tokens
from letterloom.operators.postings import forward_index, postings, term_counts


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_tokens_are_lower_cased_letters_and_digits(spark):
    assert one(spark, tokens(F.col("t")), t="Don't stop ÉLÉMENT 12.5 über_x") == [
        "don", "t", "stop", "élément", "12", "5", "über", "x",
    ]


def forward(spark, rows, stop_words=(), gap=100):
    return forward_index(spark.createDataFrame(rows, "doc_id int, field string, values array<string>"), stop_words, gap)


def test_entries_hold_positions_of_each_term(spark):
    row = forward(spark, [(1, "body", ["b a b c b"])]).first()
    assert row.len == 5
    assert [(e.term, e.pos) for e in row.entries] == [("a", [1]), ("b", [0, 2, 4]), ("c", [3])]


def test_stop_words_leave_their_positions(spark):
    row = forward(spark, [(1, "body", ["the cat is on the mat"])], ENGLISH_STOP_WORDS).first()
    assert [(e.term, e.pos) for e in row.entries] == [("cat", [1]), ("mat", [5])]
    assert row.len == 2


def test_values_of_one_field_are_apart(spark):
    row = forward(spark, [(1, "body_all", ["a b", "c a"])], gap=10).first()
    assert [(e.term, e.pos) for e in row.entries] == [("a", [0, 13]), ("b", [1]), ("c", [12])]


def test_empty_text_has_a_row_but_no_postings(spark):
    rows = forward(spark, [(1, "body", ["..."]), (2, "body", ["a a"])])
    assert {(r.doc_id, r.len) for r in rows.collect()} == {(1, 0), (2, 2)}
    assert [(r.doc_id, r.term, r.tf, r.len) for r in postings(rows).collect()] == [(2, "a", 2, 2)]
    assert [(r.term, r.df) for r in term_counts(rows).collect()] == [("a", 1)]


def test_html_to_text(spark):
    html = (
        "<html><head><title>T&amp;t</title><style>p{}</style><script>var a='<p>no</p>';</script></head>"
        "<body><!-- no <b>no</b> --><h1>Head</h1><p>one<b>two</b> three<br>four</p>&eacute;&#233;&#xe9;&nbsp;&bogus; &amp;lt;</body>"
    )
    assert one(spark, html_to_text(F.col("h")), h=html) == "T&t Head onetwo three four ééé &bogus; &lt;"


def test_invalid_references_stay(spark):
    assert one(spark, html_to_text(F.col("h")), h="&#0; &#55296; &#9999999; &#128512;") == "&#0; &#55296; &#9999999; 😀"


def test_body_text_by_content_type(spark):
    def of(kind):
        return one(spark, body_text(F.col("k"), F.col("t")), k=kind, t="<p>x</p>")

    assert of("TEXT/plain; charset=x") == "<p>x</p>"
    assert of("text/HTML") == "x"
    assert of("text/calendar") == "" and of("image/png") == ""


def test_format_bytes(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KiB", 1280: "1.3 KiB", 1048575: "1024.0 KiB", -5: "-5 B",
             2**50 - 1: "1024.0 TiB", 2**60: "1.0 EiB"}
    rows = spark.createDataFrame(list(cases.items()), "n bigint, want string")
    for row in rows.select("want", format_bytes(F.col("n")).alias("got")).collect():
        assert row.got == row.want
    assert one(spark, format_bytes(F.col("n"), si=True), n=1000) == "1.0 kB"
