"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string, key string, row string, size int"
SF = "/root/testdata/sf0.001"


def documents(spark, rows=()):
    """``(doc_id, text, lang, source)`` rows as a table with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, "k", None, "r", 7) for i, t, lang, s in rows], SCHEMA)


AWKWARD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", None, "a"),
    (None, "the same words in a row again", "en", "b"),
    (None, None, "de", None),
    (4, "the same words in a row again", "en", "b"),
    (4, "the same words in a row again", "en", "b"),
    (5, "The SAME words in a row again", "en", "b"),
    (6, "short", "en", ""),
    (7, "1234567890 %%% $$$", "en", "é"),
    (8, "ÄÖÜ straße ſecret K \U0001f389 日本語", "de", "z"),
    (9, "word " * 30_000 + "token = 'abcdefgh12345678' end", "en", "a"),
    (9, "another text under the same key", "en", "a"),
]


def sample(spark, n=200):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(n)


def clashing(df):
    """``df`` with further columns that operators might name themselves."""
    return df.withColumns({c: F.lit("x") for c in ("key", "row", "fp", "words", "spans", "rid", "at", "part", "id", "host")})
