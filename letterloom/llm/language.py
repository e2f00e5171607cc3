"""Language identification by n-gram filters that hold the languages as bits.

One Bloom filter per language, sliced by bit: a slot of the table holds one bit for each language, so one
look-up (the AND of a few slots) gives all languages that contain an n-gram. A text's n-grams are looked
up at once; each language's count, less the hits that its filter's fill would give to any n-gram, is
its share of the text, and the largest share decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from letterloom.llm.common import map_batches
from letterloom.session import written

UNKNOWN = "und"
NGRAMS = (3, 4)
# Training sample: so many texts of each language, the first by a hash of the key.
SAMPLE_TEXTS = 400
# An n-gram belongs to a language if so many of its n-grams in the sample are this one.
LEAST_SHARE = 2e-5
SLOT_BITS = 20
HASHES = 3
REJECT_BELOW = 0.2
_BASE = np.uint64(0x9E3779B97F4A7C15)
# Characters that are looked at together: bounds the memory for long texts.
_WINDOW = 1 << 18
_LETTERS = re.compile(r"[^\W\d_]+")


def letters_of(text: str | None) -> str:
    """Lower-cased letters with one space for everything between them, and at both ends; empty without letters."""
    if not text or not any(map(str.isalpha, text)):
        return ""
    return f" {' '.join(_LETTERS.findall(text.lower()))} "


def ngram_hashes(letters: str, sizes: tuple[int, ...] = NGRAMS) -> np.ndarray:
    """64-bit hashes of all n-grams of the given sizes, in any order."""
    codes = np.frombuffer(letters.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = []
    for n in sizes:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h * _BASE) ^ codes[i : i + len(h)]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _parts(letters: str, sizes: tuple[int, ...] = NGRAMS) -> Iterator[np.ndarray]:
    """Hashes of a text of any length, piece by piece; pieces overlap so that no n-gram is lost or met twice."""
    if len(letters) <= _WINDOW:
        yield ngram_hashes(letters, sizes)
        return
    for n in sizes:
        for at in range(0, len(letters) - n + 1, _WINDOW):
            yield ngram_hashes(letters[at : at + _WINDOW + n - 1], (n,))


@dataclass
class LanguageFilters:
    """``slots[i]`` holds a bit for each language, eight to a byte."""

    languages: list[str]
    slots: np.ndarray
    slot_bits: int = SLOT_BITS
    hashes: int = HASHES

    def __post_init__(self) -> None:
        ones = np.unpackbits(self.slots, axis=1, bitorder="little")[:, : len(self.languages)]
        fill = ones.mean(0) if len(self.slots) else np.zeros(len(self.languages))
        self.false_rate = fill**self.hashes
        self.bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """The languages that hold each n-gram."""
        found = None
        for slot in slots_of(hashes, self.slot_bits, self.hashes):
            one = self.slots[slot]
            found = one if found is None else found & one
        return found

    def shares(self, letters: str) -> np.ndarray:
        """Each language's share of the text's n-grams, corrected for what its filter finds by chance."""
        counts, total = np.zeros(self.slots.shape[1] * 8, np.int64), 0
        for hashes in _parts(letters):
            masks = self.masks(hashes)
            total += len(hashes)
            for b in range(masks.shape[1]):
                counts[b * 8 : b * 8 + 8] += np.bincount(masks[:, b], minlength=256) @ self.bits
        hits = counts[: len(self.languages)]
        return np.clip((hits - total * self.false_rate) / np.maximum((1 - self.false_rate) * total, 1e-9), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        letters = letters_of(text)
        if not letters or not self.languages:
            return UNKNOWN, 0.0
        shares = self.shares(letters)
        best = int(np.argmax(shares))  # the first of equal ones
        return self.languages[best], float(shares[best])


def slots_of(hashes: np.ndarray, slot_bits: int, n: int) -> Iterator[np.ndarray]:
    mask = np.uint64((1 << slot_bits) - 1)
    for i in range(n):
        yield (hashes >> np.uint64(i * slot_bits)) & mask


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> LanguageFilters:
    """Filters of the languages in ``lang``, from at most ``sample_texts`` texts of each (null ones are no sample).

    The sample is the first texts of each language by a hash of key and text, so it is the same however the table
    is partitioned. Languages are counted first, and only texts whose hash lies in a share of all hashes that is four
    times the sample's are ranked, so a language ranks a few times its sample, whatever the number of tasks.
    n-grams are counted in the tasks and summed; the driver gets those frequent enough, at most ``1 / LEAST_SHARE``
    for each language.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key, text).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labels = docs.select(F.col(lang).alias("lang")).where("lang is not null")  # reads no texts
    sizes = written(labels.groupBy("lang").agg(F.count("*").alias("size")), "language-sizes")
    place = F.col("h") / F.lit(2.0**64) + 0.5
    rows = rows.join(sizes, "lang").where(place * F.col("size") <= 4 * sample_texts)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = rows.withColumn("nth", nth).where(F.col("nth") <= sample_texts).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for hashes in _parts(letters_of(text)):
                    grams, n = np.unique(hashes, return_counts=True)
                    langs = pa.array([lang] * len(grams), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([langs, pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    schema = StructType([StructField("lang", rows.schema["lang"].dataType), *StructType.fromDDL("gram bigint, n bigint").fields])
    grams = written(map_batches(sample, count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-ngrams")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("all"))
    frequent = grams.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("all") * LEAST_SHARE)
    languages = sorted(r[0] for r in totals.select("lang").collect())
    slots = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 8))), np.uint8)
    at = {v: i for i, v in enumerate(languages)}
    table = frequent.select("lang", "gram").toArrow()
    for lang in languages:
        own = table.filter(pc.equal(table["lang"], lang))["gram"].to_numpy().view(np.uint64)
        for slot in slots_of(own, SLOT_BITS, HASHES):
            slots[slot, at[lang] // 8] |= np.uint8(1 << at[lang] % 8)
    return LanguageFilters(languages, slots)


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: one in four, by a checksum of its key (a null key: not)."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predicted(docs: DataFrame, filters: LanguageFilters, text: str = "text") -> DataFrame:
    """All columns of ``docs`` as struct ``row``, with ``lang_pred`` and ``score`` from the whole text alone."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2 ** SLOT_BITS bytes for every eight languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(0).field(place)]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score"])

    schema = StructType([rows.schema["row"], *StructType.fromDDL("lang_pred string, score double").fields])
    return map_batches(rows, run, schema)


def in_language(docs: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """``docs`` without the rows whose text has no letters or is in none of the languages the labels teach."""
    filters = learn(docs.where(~held_out(F.col("doc_id"))))
    rows = predicted(docs, filters).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= reject_below))
    return rows.select("row.*")


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    Learned from rows that are not held out and have a label; a null text or one without letters is ``und`` with
    score 0, and so is every text if nothing could be learned. Equal shares go to the first language in order. Null
    keys, repeated rows and further columns are allowed; an empty table gives no rows.
    """
    filters = learn(docs.where(~held_out(F.col("doc_id"))))
    rows = predicted(docs.select("doc_id", "text"), filters)
    return rows.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
