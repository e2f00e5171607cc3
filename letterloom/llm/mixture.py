"""Mixing sources to target weights: equal-token blocks dealt to sources by Sainte-Lague apportionment.

A source's documents, in a seeded order, make one stream of words that is cut into blocks of equal
size. Capped sources are taken whole as often as the cap allows. The others share as many blocks as
their targets fill; each goes to the source with the highest quotient of target and 2k - 1, k being the
block's number in that source. The first blocks of this sequence make the first shard, and so on, so every
shard holds the sources in the same proportions. A source with more quota than words takes all of them
again. Targets of sources that are not capped are at most three times each other; blocks are no
larger than a ``LEAST_BLOCKS``-th of the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions.text import bind
from letterloom.session import written

WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_SPACE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
BLOCK_WORDS = 64
LEAST_BLOCKS = 64
SHARDS = 16
MOST_COPIES = 3
SEED = 20
# Documents that share one window when a source's stream is laid out, and most such groups of a source.
GROUP_ROWS = 64
MOST_GROUPS = 1 << 16
# Primes that step through a source's blocks; the second serves block counts that the first divides.
_STEPS = (2654435761, 2654435789)


def _over_all(value: Column) -> Column:
    """``value`` over all rows of a table with one row per source (and shard)."""
    return value.over(Window.partitionBy(F.lit(0)).orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, sid, docs, words, weight, capped, target)`` from rows of ``(source, size)``.

    Sources in order, null last, weigh 1, 2, 3, 1, ... Targets share all words by weight, but none is more
    than three times its source; what is over goes to the others by weight. In the order of cap over weight
    the capped sources come first, so running sums find them all at once. The windows run over one row per
    source.
    """
    table = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("words"))
    sid = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    table = table.withColumn("sid", sid).withColumn("weight", F.pmod(F.col("sid") - 1, F.lit(3)) + 1)
    table = table.withColumn("cap", F.col("words") * MOST_COPIES).withColumn("fills_at", F.col("cap") / F.col("weight"))
    before = Window.partitionBy(F.lit(0)).orderBy("fills_at", "sid").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    level = (_over_all(F.sum("words")) - so_far("cap")) / (_over_all(F.sum("weight")) - so_far("weight"))
    table = table.withColumn("capped", F.col("fills_at") <= level)
    rest = _over_all(F.sum("words")) - F.coalesce(_over_all(F.sum(F.when(F.col("capped"), F.col("cap")))), F.lit(0))
    free = _over_all(F.sum(F.when(~F.col("capped"), F.col("weight"))))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(rest * F.col("weight") / free)
    return table.withColumn("target", target).select("source", "sid", "docs", "words", "weight", "capped", "target")


def shard_quotas(targets: DataFrame, block_words: int | Column = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """``(sid, shard, quota)``: integer numbers of blocks, by highest quotients over all shards up to each.

    The first m blocks hold, for every source, at least the seats that are sure under a divisor no smaller than the
    true one; only the few seats around the cut are ranked.
    """
    table = targets.where("target > 0").withColumn("all", _over_all(F.sum("target"))).withColumn("n", _over_all(F.count("*")))
    table = table.withColumn("end", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    table = table.withColumn("m", F.floor(F.greatest(F.round(F.col("all") / block_words), F.lit(1)) * F.col("end") / shards))
    share = F.col("target") / F.col("all")
    sure = F.floor(share * (F.col("m") - F.col("n") / 2) + 0.5) - 1
    table = table.withColumn("sure", F.greatest(sure, F.lit(0)))
    more = F.least(F.ceil(share * F.col("n")) + 4, F.col("m"))
    table = table.withColumn("left", F.col("m") - F.sum("sure").over(Window.partitionBy("end")))
    seats = table.withColumn("seat", F.explode(F.sequence(F.lit(1).cast("long"), more))).where("m > 0")
    order = Window.partitionBy("end").orderBy((F.col("target") / (2 * (F.col("sure") + F.col("seat")) - 1)).desc(), "sid")
    won = seats.withColumn("place", F.row_number().over(order)).where("place <= left").groupBy("sid", "end").agg(F.count("*").alias("won"))
    total = table.join(won, ["sid", "end"], "left").withColumn("upto", F.col("sure") + F.coalesce("won", F.lit(0)))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("sid").orderBy("end")), F.lit(0))
    return total.select("sid", (F.col("end") - 1).alias("shard"), (F.col("upto") - before).cast("long").alias("quota"))


def _block(most: int) -> Column:
    """Words of a block, over a table with one row per source that is not capped."""
    return F.least(F.lit(most).cast("long"), F.greatest(F.floor(_over_all(F.min("target")) / LEAST_BLOCKS), F.lit(1).cast("long")))


def _chosen(block: Column) -> Column:
    """Whether a block is among the source's ``extra`` ones: the first in the order of a seeded step."""
    step = F.when(F.pmod(F.col("blocks"), F.lit(_STEPS[0])) == 0, _STEPS[1]).otherwise(_STEPS[0])
    place = F.pmod(block.cast("decimal(20,0)") * step.cast("decimal(10,0)") + F.col("shift"), F.col("blocks").cast("decimal(20,0)"))
    return place < F.col("extra")


def mixture(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", carry: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs`` with ``size, source_size, target, taken`` and what :func:`mixed` needs; ``carry`` keeps
    all columns as struct ``row``.

    ``taken`` is the number of the row's words in the mix, repeats counted, at most three times its size. Rows with
    no words take none. Null keys, sources and texts, repeated rows and clashing columns are allowed: rows that are alike
    in key, source and size may change places, which changes no row of the result as a whole. Only sizes are shuffled
    unless ``carry`` is set, by source and a hash group within it, never by source alone.
    """
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(key), F.lit(SEED)).alias("h"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    sizes = written(rows.drop("row"), "mixture-sizes")
    rows = rows if carry else sizes
    targets = written(source_targets(sizes), "mixture-sources")
    free = targets.where(~F.col("capped")).withColumn("block", _block(block_words))
    quota = shard_quotas(free, F.col("block")).groupBy("sid").agg(F.sum("quota").alias("quota"))
    sources = targets.join(quota, "sid", "left").join(free.select("sid", "block"), "sid", "left")
    sources = sources.withColumn("block", F.coalesce("block", F.lit(block_words).cast("long")))
    sources = sources.withColumn("blocks", F.greatest(F.ceil(F.col("words") / F.col("block")), F.lit(1)))
    # words, as the last block of a source is seldom full
    most = F.col("words") * MOST_COPIES
    share = F.when(F.col("capped"), most).otherwise(F.least(F.coalesce("quota", F.lit(0)) * F.col("block"), most))
    sources = sources.withColumn("share", share).withColumn("rounds", F.floor(F.col("share") / F.greatest("words", F.lit(1))))
    extra = F.round((F.col("share") - F.col("rounds") * F.col("words")) / F.col("block")).cast("long")
    sources = sources.select(
        F.col("source").alias("of_source"),
        "sid",
        F.col("words").alias("source_size"),
        "target",
        "block",
        "blocks",
        "rounds",
        F.least(extra, "blocks").alias("extra"),
        F.pmod(F.xxhash64("source", F.lit(SEED)), F.col("blocks")).alias("shift"),
        F.least(F.ceil(F.col("docs") / GROUP_ROWS), F.lit(MOST_GROUPS)).alias("groups"),
    )
    sources = written(sources, "mixture-quotas")

    def placed(some: DataFrame) -> DataFrame:
        joined = some.join(sources, some["source"].eqNullSafe(sources["of_source"]))
        return joined.withColumn("part", F.pmod("h", "groups"))

    earlier = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed(sizes).groupBy("sid", "part").agg(F.sum("size").alias("words"))
    starts = starts.select("sid", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("sid", "part").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed(rows).join(starts, ["sid", "part"]).withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    end = F.col("at") + F.col("size")
    of_blocks = F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((end - 1) / F.col("block")))
    words = lambda k: F.least(end, (k + 1) * F.col("block")) - F.greatest(F.col("at"), k * F.col("block"))
    part = F.aggregate(of_blocks, F.lit(0).cast("long"), lambda n, k: n + F.when(_chosen(k), words(k)).otherwise(F.lit(0)))
    return laid.withColumn("part_words", F.when(F.col("size") > 0, part).otherwise(F.lit(0))).withColumn(
        "taken", F.col("rounds") * F.col("size") + F.col("part_words")
    )


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as rows of ``docs``: whole copies, and texts of the chosen blocks' words where only some are taken.

    ``n_chars`` follows the text. Rows of which nothing is taken are left out.
    """
    rows = mixture(docs, carry=True, block_words=block_words)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rounds") + F.when(F.col("part_words") > 0, 1).otherwise(0))))
    rows = rows.where(F.col("copy") > 0)  # sequence(1, 0) counts down
    kept = lambda words: F.filter(words, lambda _, i: _chosen(F.floor((F.col("at") + i) / F.col("block"))))
    some = bind(F.regexp_extract_all("row.text", F.lit(WORD_AND_SPACE), F.lit(0)), lambda w: F.rtrim(F.array_join(kept(w), "")))
    whole = (F.col("copy") <= F.col("rounds")) | (F.col("part_words") == F.col("size"))
    out = rows.where("taken > 0").select("row", F.when(whole, F.col("row.text")).otherwise(some).alias("text"))
    columns = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mixture_report(docs: DataFrame) -> DataFrame:
    """Sizes, targets and words taken, one row per document."""
    return mixture(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
