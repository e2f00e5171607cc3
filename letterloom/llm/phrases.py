"""Collocations: each language's best phrases, grown best-first under bounds that prefix counts give.

A phrase's score is ``1000 * a * n / (l * r)`` at its lowest-scoring cut (``a`` its count, ``l`` and ``r`` those of the
two parts, ``n`` the language's words). Whatever follows a prefix ``q``, cutting after ``q`` has ``a <= r``, so no phrase
that starts with ``q`` scores above ``1000 * n / f(q)``: the rarer the prefix, the higher the bound. The frontier therefore
grows from the rarest first words on; words more frequent than ``reach`` stay closed. A language is settled when
its ``top``-th surviving score, ties included, lies above the bound of every closed word; until then ``reach`` rises.

Texts are read once: each batch becomes a row of local word numbers (``ids``) with the words' 64-bit codes (``codes``).
Further passes over these rows count phrases inside the tasks by exact word numbers, and Spark sums the counts by codes.
Which phrases a pass counts is told by bitmaps of fixed size; what they let through by chance is dropped by exact
counts or joins. Codes that two words share are looked for, and another seed is taken if one counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.llm.common import map_batches
from letterloom.session import empty, written

LONGEST = 5
LEAST = 100
TOP = 2000
UNLABELLED = "und"
# Words of up to so many times the least count are opened first; then so many times more, while a language has too few phrases.
FIRST = 64
WIDEN = 64
# Bytes of texts that are numbered together: a row of the numbered texts, whose passes take some ten times its bytes.
TOGETHER = 2 << 20
# Bytes of rows that a Python worker gets at once: two rows of numbered texts, whose arrays it holds several times.
BATCH = "4m"
# Bits of a bitmap: 2 MB. Fuller bitmaps let more phrases through to the exact counts.
FILTER_BITS = 24

_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
_CORPUS = "lang string, n bigint, words array<string>, codes array<bigint>, counts array<bigint>, ids binary"
# Bytes to what words are cut at: A-Z in lower case, tab as space, and all ends of pieces as a line feed.
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[9] = 32
_TABLE[list(b".,;:!?\n\x0b\x0c\r")] = 10


# Hashing of phrases, alike for counted tables and for texts


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hash(words: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases, given as one array of codes for each place."""
    h = _mix(words[0] + np.uint64(0x9E3779B97F4A7C15))
    for w in words[1:]:
        h = _mix(h * np.uint64(0x94D049BB133111EB) + w)
    return h


@dataclass
class Bitmap:
    """Which phrases may be meant: never says no to one that is."""

    bits: np.ndarray  # uint64
    log_size: int

    def __or__(self, other: Bitmap) -> Bitmap:
        return Bitmap(self.bits | other.bits, self.log_size)

    def has(self, words: list[np.ndarray]) -> np.ndarray:
        slot = _hash(words) >> np.uint64(64 - self.log_size)
        return (self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(phrases: DataFrame, log_size: int = FILTER_BITS) -> Bitmap:
    """The bitmap of a table of phrases (columns ``w1`` on, 0 after the last word); the driver gets 2 ** log_size bits at most."""
    names = [c for c in _WORDS if c in phrases.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(c).to_numpy().view(np.uint64) for c in names]
            lengths = sum((w != 0).astype(np.int64) for w in words)
            for m in range(1, len(names) + 1):
                some = [w[lengths == m] for w in words[:m]]
                slot = np.unique(_hash(some) >> np.uint64(64 - log_size))
                place, first = np.unique(slot >> np.uint64(6), return_index=True)
                if len(place):
                    ones = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (place, ones)], ["place", "ones"])

    rows = map_batches(phrases.select(*names), run, "place bigint, ones bigint", BATCH)
    table = rows.groupBy("place").agg(F.bit_or("ones").alias("ones")).toArrow()
    bits = np.zeros(max(1, 1 << log_size >> 6), np.uint64)
    bits[table["place"].to_numpy()] = table["ones"].to_numpy().view(np.uint64)
    return Bitmap(bits, log_size)


# Texts to local word numbers


def _numbered(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct words of texts without nulls, and all texts as their numbers from 1; 0 ends a piece."""
    lines = pc.binary_join_element_wise(texts, "", "\n")
    start, end = lines.offset, lines.offset + len(lines)
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[start : end + 1]
    data = _TABLE[np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    whole = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(data)], np.int32)), pa.py_buffer(data))
    coded = pc.split_pattern(whole, " ").flatten().dictionary_encode()
    numbers: dict[str, int] = {}
    pool: list[int] = []
    sizes: list[int] = []
    for token in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
        before = len(pool)
        if "\n" in token:
            for i, word in enumerate(token.split("\n")):
                if i and (len(pool) == before or pool[-1]):
                    pool.append(0)
                if word:
                    pool.append(numbers.setdefault(word, len(numbers) + 1))
        elif token:
            pool.append(numbers.setdefault(token, len(numbers) + 1))
        sizes.append(len(pool) - before)
    lengths = np.array(sizes, np.int64)
    starts = np.cumsum(lengths) - lengths
    which = coded.indices.to_numpy()
    lengths = lengths[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    places = np.repeat(starts[which] - ends + lengths, lengths) + np.arange(total)
    return list(numbers), np.array(pool, np.int32)[places] if total else np.empty(0, np.int32)


def encoded(docs: DataFrame, text: str = "text", lang: str = "lang", seed: int = 0) -> DataFrame:
    """A row for each language of a batch of texts: ``n`` words, the distinct ``words`` with their ``codes`` and ``counts``,
    and all texts as ``ids`` (32-bit numbers of ``words`` from 1, 0 where a piece ends)."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNLABELLED)).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))

    def numbered_row(lang: str, words: list[str], ids: np.ndarray) -> pa.RecordBatch:
        own = lang.encode() + b"\0"
        codes = np.fromiter((xxhash.xxh64_intdigest(own + w.encode(), seed) or 1 for w in words), np.uint64, len(words))
        counts = np.bincount(ids, minlength=len(words) + 1)[1:]
        return pa.RecordBatch.from_pydict(
            {
                "lang": [lang],
                "n": pa.array([int(counts.sum())], pa.int64()),
                "words": pa.array([words], pa.list_(pa.string())),
                "codes": _one_list(codes.view(np.int64)),
                "counts": _one_list(counts),
                "ids": [ids.tobytes()],
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                texts = batch.column("text").filter(pc.equal(batch.column("lang"), lang))
                group = np.cumsum(pc.binary_length(texts).to_numpy()) // TOGETHER
                cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
                for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                    yield numbered_row(lang, *_numbered(texts[start:stop]))

    return map_batches(rows, run, _CORPUS, BATCH)


def _one_list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int64)))


# Passes over the numbered texts


@dataclass
class Chunk:
    """One row of the numbered texts: ``ids`` with 0 for rare words too, ``codes[id]`` the words' codes (0: none)."""

    ids: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, ids: bytes, frequent: Bitmap) -> Chunk:
        own = codes.view(np.uint64)
        known = np.concatenate([np.zeros(1, np.uint64), np.where(frequent.has([own]), own, np.uint64(0))])
        numbers = np.frombuffer(ids, np.int32)
        numbers = np.where(known[numbers] != 0, numbers, 0)
        # a break at both ends and room for the longest phrase
        return cls(np.concatenate([[0], numbers, np.zeros(LONGEST, np.int32)]).astype(np.int32), known)

    def starts(self, m: int, first: np.ndarray | None = None) -> np.ndarray:
        """Where ``m`` words follow one another, the first of them chosen by ``first`` (by number)."""
        at = np.flatnonzero(first[self.ids] if first is not None else self.ids != 0)
        for i in range(1, m):
            at = at[self.ids[at + i] != 0]
        return at

    def phrase(self, at: np.ndarray, m: int) -> list[np.ndarray]:
        return [self.codes[self.ids[at + i]] for i in range(m)]

    def distinct(self, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct phrase at ``at``, and which of them stands at each."""
        which = self.ids[at].astype(np.int64)
        first = np.arange(len(at))
        for i in range(1, m):
            _, first, which = np.unique(which * len(self.codes) + self.ids[at + i], return_index=True, return_inverse=True)
        return at[first], which


def _pass(corpus: DataFrame, frequent: Bitmap, emit: Callable[[Chunk], Iterator[dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """What ``emit`` finds in each row of the numbered texts."""
    shared = corpus.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes = batch.column("codes")[row].values.to_numpy()
                for found in emit(Chunk.of(codes, batch.column("ids")[row].as_buffer(), shared.value)):
                    yield pa.RecordBatch.from_pydict({k: pa.array(v.astype(np.int64)) for k, v in found.items()})

    return map_batches(corpus.select("codes", "ids"), run, schema, BATCH)


def _columns(words: list[np.ndarray], n: int = LONGEST) -> dict[str, np.ndarray]:
    none = np.zeros(len(words[0]), np.uint64)
    return {name: (words[i] if i < len(words) else none).view(np.int64) for i, name in enumerate(_WORDS[:n])}


def _grown(corpus: DataFrame, m: int, frequent: Bitmap, opened: Bitmap, open_before: Bitmap, prefixes: Bitmap | None, counted: Bitmap | None) -> DataFrame:
    """``w1 .. w5, f``: counts of phrases of ``m`` words whose first word is ``opened``.

    Beyond two words the prefix must be among ``prefixes``, and the rest among ``counted`` if its first word is open too.
    """
    share = corpus.sparkSession.sparkContext.broadcast
    opened_, before_, prefixes_, counted_ = share(opened), share(open_before), share(prefixes), share(counted)

    def emit(chunk: Chunk) -> Iterator[dict[str, np.ndarray]]:
        real = chunk.codes != 0
        first = real & opened_.value.has([chunk.codes])
        at = chunk.starts(m, first)
        if m > 2:
            at = at[prefixes_.value.has(chunk.phrase(at, m - 1))]
            closed = ~(first | real & before_.value.has([chunk.codes]))
            at = at[closed[chunk.ids[at + 1]] | counted_.value.has(chunk.phrase(at + 1, m - 1))]
        if len(at):
            places, which = chunk.distinct(at, m)
            yield _columns(chunk.phrase(places, m)) | {"f": np.bincount(which)}

    schema = ", ".join(f"{c} bigint" for c in [*_WORDS, "f"])
    return _pass(corpus, frequent, emit, schema).groupBy(*_WORDS).agg(F.sum("f").alias("f"))


def _looked_up(corpus: DataFrame, frequent: Bitmap, wanted: Bitmap) -> DataFrame:
    """``w1 .. w4, f, left0, left1, right0, right1``: counts of the wanted phrases of 2 to 4 words, and the least and
    greatest codes of the words before and after them (0: none, or a rare one)."""
    wanted_ = corpus.sparkSession.sparkContext.broadcast(wanted)
    names = _WORDS[: LONGEST - 1]

    def emit(chunk: Chunk) -> Iterator[dict[str, np.ndarray]]:
        for m in range(2, LONGEST):
            at = chunk.starts(m)
            at = at[wanted_.value.has(chunk.phrase(at, m))]
            if not len(at):
                continue
            places, which = chunk.distinct(at, m)
            order = np.argsort(which, kind="stable")
            n = np.bincount(which)
            ends = np.cumsum(n) - n
            out = _columns(chunk.phrase(places, m), LONGEST - 1) | {"f": n}
            for side, near in (("left", at - 1), ("right", at + m)):
                codes = chunk.codes[chunk.ids[near]].view(np.int64)[order]
                out |= {f"{side}0": np.minimum.reduceat(codes, ends), f"{side}1": np.maximum.reduceat(codes, ends)}
            yield out

    sides = ["left0", "left1", "right0", "right1"]
    rows = _pass(corpus, frequent, emit, ", ".join(f"{c} bigint" for c in [*names, "f", *sides]))
    ends = [(F.min if c[-1] == "0" else F.max)(c).alias(c) for c in sides]
    return rows.groupBy(*names).agg(F.sum("f").alias("f"), *ends)


# Words


def _frequent_words(corpus: DataFrame, least: int) -> tuple[Bitmap, DataFrame] | None:
    """Bitmap and table ``(lang, word, w1, f)`` of the words that occur often enough; None if one of them shares its code."""
    each = corpus.select("lang", F.explode(F.arrays_zip("words", "codes", "counts")).alias("x"))
    each = each.select("lang", F.col("x.words").alias("word"), F.col("x.codes").alias("w1"), F.col("x.counts").alias("f"))
    every = written(each.groupBy("lang", "word", "w1").agg(F.sum("f").alias("f")), "phrases-vocabulary")
    shared = every.groupBy("w1").agg(F.count("*").alias("n"), F.max("f").alias("most")).where((F.col("n") > 1) & (F.col("most") >= least))
    if not shared.isEmpty():
        return None
    words = written(every.where(F.col("f") >= least), "phrases-words")
    return bitmap(words.select("w1")), words


# Scores


def _cuts(phrases: DataFrame) -> DataFrame:
    """``k`` and the words of both parts (``l1 .. l4``, ``r1 .. r4``) for each cut of each phrase."""
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    place = lambda i: F.element_at("words", F.lit(i).cast("int"))
    words = F.array(*_WORDS, *[F.lit(0).cast("long")] * LONGEST)
    left = [F.when(F.col("k") >= i, place(i)).otherwise(0).alias(f"l{i}") for i in range(1, LONGEST)]
    right = [F.element_at("words", (F.col("k") + i).cast("int")).alias(f"r{i}") for i in range(1, LONGEST)]
    return cut.withColumn("words", words).select(*phrases.columns, "k", *left, *right)


def _scored(phrases: DataFrame, parts: DataFrame) -> DataFrame:
    """``phrases`` with ``l, r, score`` of the lowest-scoring cut (the first of equal ones); ``parts`` has the counts of all parts."""
    names = _WORDS[: LONGEST - 1]
    cuts = _cuts(phrases)
    for side in "lr":
        own = parts.select(*[F.col(c).alias(f"{side}{i}") for i, c in enumerate(names, 1)], F.col("f").alias(side))
        cuts = cuts.join(own, [f"{side}{i}" for i in range(1, LONGEST)])
    # 38 digits hold 1000 * a * n, and `div` gives the whole part of the exact quotient
    score = F.expr("(cast(a as decimal(19, 0)) * 1000 * cast(n as decimal(15, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = cuts.withColumn("score", score).groupBy(*phrases.columns).agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select(*phrases.columns, "best.l", "best.r", "best.score")


def _suffixes(phrases: DataFrame) -> DataFrame:
    """All phrases of 2 to 4 words that are one of ``phrases`` or end one."""
    padded = F.array(*_WORDS, *[F.lit(0).cast("long")] * LONGEST)
    rows = phrases.withColumn("words", padded).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 2)))
    rows = rows.where((F.col("m") - F.col("k")) < LONGEST)
    return rows.select(*[F.element_at("words", (F.col("k") + i).cast("int")).alias(f"w{i}") for i in range(1, LONGEST)]).distinct()


def top_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, first: int = FIRST, widen: int = WIDEN
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` best phrases of 2 to 5 words of each language.

    Null texts are empty, a null language is ``und``; a repeated row counts as often as it stands there. Phrases do not
    cross the end of a piece or of a text. Equal scores are ordered by count, then by the phrase's bytes. Other columns are
    not read; a table without frequent phrases gives no rows.
    """
    spark = docs.sparkSession
    seed = 0
    while True:
        corpus = written(encoded(docs, text, lang, seed), "phrases-corpus")
        found = _frequent_words(corpus, least)
        if found:
            break
        seed += 1
    frequent, words = found
    sizes = corpus.groupBy("lang").agg(F.sum("n").alias("n"))
    most = words.groupBy("lang").agg(F.max("f").alias("most"))
    # what is open: words of more than `below` and up to `reach` occurrences; most of a language's words are rare and open at once
    state = written(sizes.join(most, "lang").select("lang", "n", "most", F.lit(0).cast("long").alias("below"), F.lit(least * first).cast("long").alias("reach")), "phrases-state")
    survivors: DataFrame = empty(spark, "lang string, n bigint, " + ", ".join(f"{c} bigint" for c in _WORDS) + ", m int, a bigint, l bigint, r bigint, score bigint")
    grown_before: dict[int, Bitmap] = {}
    open_before = bitmap(words.select("w1").limit(0))
    while not state.isEmpty():
        opening = words.join(state, "lang").where("f > below and f <= reach").select("w1", "lang", "n")
        opening = written(opening, "phrases-open")
        opened = bitmap(opening.select("w1"))
        counted: dict[int, DataFrame] = {}
        prefixes = None
        for m in range(2, LONGEST + 1):
            if m > 2:
                if counted[m - 1].isEmpty():
                    break
                prefixes = bitmap(counted[m - 1])
                grown_before[m - 1] = grown_before.get(m - 1, prefixes) | prefixes
            # a word that the bitmap opens by chance is counted like the others, and left out by the join below
            grown = _grown(corpus, m, frequent, opened, open_before, prefixes, grown_before.get(m - 1)).where(F.col("f") >= least)
            counted[m] = written(grown.withColumn("m", F.lit(m)), "phrases-grown")
        open_before = open_before | opened
        new = reduce(DataFrame.unionByName, counted.values()).join(opening, "w1")
        wanted = written(_suffixes(new), "phrases-wanted")
        if not wanted.isEmpty():
            near = _looked_up(corpus, frequent, bitmap(wanted)).join(wanted, _WORDS[: LONGEST - 1], "left_semi")
            near = written(near, "phrases-parts")
            none = [F.lit(0).cast("long").alias(c) for c in _WORDS[1 : LONGEST - 1]]
            parts = near.select(*_WORDS[: LONGEST - 1], "f").unionByName(words.select("w1", *none, "f"))
            scored = _scored(new.withColumnRenamed("f", "a"), parts)
            # a longer candidate occurs as often if all words before it, or all words after it, are one word
            inside = near.where("(left0 = left1 and left0 <> 0) or (right0 = right1 and right0 <> 0)").select(*_WORDS[: LONGEST - 1], F.lit(0).cast("long").alias("w5"))
            kept = scored.join(inside, _WORDS, "left_anti").select(*survivors.columns)
            survivors = written(survivors.unionByName(kept), "phrases-kept")
        state = written(_unsettled(state, survivors, top, widen), "phrases-state")
    return _ranked(survivors, words, top)


def _unsettled(state: DataFrame, survivors: DataFrame, top: int, widen: int) -> DataFrame:
    """The languages that a closed word may still give one of the best phrases, with what is opened next."""
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
    level = survivors.select("lang", "score").withColumn("nth", nth).where(F.col("nth") <= top)
    level = level.groupBy("lang").agg(F.count("*").alias("have"), F.min("score").alias("level"))
    rows = state.join(level, "lang", "left").withColumn("enough", F.coalesce(F.col("have") >= top, F.lit(False)))
    # floor(1000 * n / (reach + 1)) is the best that a closed word can give
    settled = (F.col("reach") >= F.col("most")) | (F.col("enough") & F.expr("(1000 * n) div (reach + 1) < level"))
    reach = F.when(F.col("enough"), F.expr("(1000 * n) div greatest(level, 1)")).otherwise(F.col("reach") * widen)
    return rows.where(~settled).select("lang", "n", "most", F.col("reach").alias("below"), F.greatest(reach, F.col("reach") + 1).alias("reach"))


def _ranked(survivors: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The best phrases as texts; strings are joined to those that are, or tie with, the best only."""
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    best = written(survivors.withColumn("place", place).where(F.col("place") <= top).drop("place"), "phrases-best")
    for c in _WORDS:
        best = best.join(words.select(F.col("w1").alias(c), F.col("word").alias(f"{c}_text")), c, "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *[f"{c}_text" for c in _WORDS]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
