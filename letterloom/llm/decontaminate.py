"""Benchmark decontamination: test n-grams as a hash set, looked up at every word of every text.

DataFrame functions alone. A text is cut into words once; at each word the hash of the window from
there is looked up in the set of the test windows' hashes, and a hit is verified against the set of
the windows themselves, all inside the row: no window of a clean text leaves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.text import bind
from letterloom.session import written

WINDOW_WORDS = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_AND_REST = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Distinct windows that are sent along with every task: about 10 MB with their hashes.
SENT_WINDOWS = 50_000

_FOUND = "array<struct<at:int,len:int,gram:string>>"


def words_of(text: Column) -> Column:
    """A to Z lower-cased, cut into words of digits, letters and all signs beyond ASCII. Null has none."""
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.coalesce(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """``(item, len, gram, hash)``: the distinct windows of each item; an item shorter than a window is one itself."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    words = words.withColumn("len", F.least(F.size("words"), F.lit(size)))
    cut = words.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)))
    window = F.slice("words", F.col("at"), F.col("len"))
    return cut.select("item", "len", F.array_join(window, " ").alias("gram"), F.xxhash64(window).alias("hash")).distinct()


def _starts(words: Column, size: int) -> Column:
    """1-based places at which a window of ``size`` words starts; none if there are fewer words."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))


def _windows_of(words: Column, size: int) -> Column:
    """``array<struct<at, len, gram>>``: all windows of one size."""
    gram = lambda i: F.array_join(F.slice(words, i, F.lit(size)), " ")
    return F.transform(_starts(words, size), lambda i: F.struct((i - 1).alias("at"), F.lit(size).alias("len"), gram(i).alias("gram")))


def _looked_up(words: Column, known: dict[int, tuple[list[int], list[str]]]) -> Column:
    """``array<struct<at, len, gram>>``: the windows of one text that are among those of their length."""

    def of_size(size: int, hashes: list[int], grams: list[str]) -> Column:
        window = lambda i: F.slice(words, i, F.lit(size))
        hit = F.filter(_starts(words, size), lambda i: F.xxhash64(window(i)).isin(hashes) & F.array_join(window(i), " ").isin(grams))
        return F.transform(hit, lambda i: F.struct((i - 1).alias("at"), F.lit(size).alias("len"), F.array_join(window(i), " ").alias("gram")))

    return F.concat(F.array().cast(_FOUND), *[of_size(size, *sets) for size, sets in sorted(known.items())])


def scanned(docs: DataFrame, windows: DataFrame, text: str = "text", sent_windows: int = SENT_WINDOWS) -> DataFrame:
    """All columns of ``docs`` as struct ``row``, with ``n_words`` and the verified windows ``found``.

    Up to ``sent_windows`` distinct windows, a number that is counted first, travel with the tasks and the
    documents are not shuffled. More of them are joined by Spark, with each window of each text as a row.
    """
    distinct = windows.select("len", "hash", "gram").distinct()
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    words = words_of(docs[text])
    if distinct.count() <= sent_windows:
        known: dict[int, tuple[list[int], list[str]]] = {}
        for size, code, gram in distinct.collect():  # bounded by the count above
            for values, value in zip(known.setdefault(size, ([], [])), (code, gram), strict=True):
                values.append(value)
        scan = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _looked_up(w, known).alias("found")))
        return docs.select(row, scan.alias("scan")).select("row", "scan.n_words", "scan.found")
    rows = written(docs.select(row, words.alias("words"), F.monotonically_increasing_id().alias("rid")), "decontaminate-words")
    sizes = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most the window length
    spots = F.flatten(F.array(*[_windows_of(F.col("words"), size) for size in sizes]))
    hits = rows.select("rid", F.inline(spots)).join(distinct.select("len", "gram"), ["len", "gram"])
    found = hits.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("at", "len", "gram"))).alias("found"))
    return rows.join(found, "rid", "left").select(
        "row", F.size("words").cast("long").alias("n_words"), F.coalesce("found", F.array().cast(_FOUND)).alias("found")
    )


def hit_words(found: Column) -> Column:
    """Places of the words that lie in any of the windows, each once."""
    return F.array_distinct(F.flatten(F.transform(found, lambda f: F.sequence(f["at"], f["at"] + f["len"] - 1))))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark, or (``remove="spans"``) without those
    words. Rows of which nothing is found stay as they are, null and empty texts among them."""
    rows = scanned(docs, benchmark_windows(benchmark), text, **options)
    if remove == "documents":
        return rows.where(F.size("found") == 0).select("row.*")
    if remove != "spans":
        raise ValueError("remove must be documents or spans")
    pieces = F.regexp_extract_all(F.col("row")[text], F.lit(WORD_AND_REST), F.lit(0))
    clean = bind(hit_words(F.col("found")), lambda hit: F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains(hit, i)), ""))
    new = F.when(F.size("found") > 0, clean).otherwise(F.col("row")[text])
    return rows.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``(key, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs``.

    Null and empty texts have no words and no hits; items without words, or null, match nothing; items that are alike
    all count; repeated rows and null keys each give a row; other columns are ignored; an empty benchmark
    hits nothing.
    """
    windows = written(benchmark_windows(benchmark), "decontaminate-windows")
    rows = scanned(docs.select(key, "text"), windows, **options)
    grams = F.array_distinct(F.transform("found", lambda f: f["gram"]))
    rows = rows.select(
        F.col("row")[key].alias("key"),
        F.monotonically_increasing_id().alias("rid"),
        "n_words",
        F.size(hit_words(F.col("found"))).cast("long").alias("n_hit"),
        grams.alias("grams"),
    )
    rows = written(rows, "decontaminate-rows")  # fixes the row numbers
    hits = rows.where(F.size("grams") > 0).select("rid", F.explode("grams").alias("gram"))
    items = hits.join(windows.select("gram", "item").distinct(), "gram").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",")
    return rows.join(items, "rid", "left").select(
        F.col("key").alias(key),
        "n_words",
        "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
