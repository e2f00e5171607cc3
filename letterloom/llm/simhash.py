"""Near duplicates by SimHash: fingerprints that differ in few bits, found through shared blocks.

Cut 64 bits into ``BLOCKS`` blocks: two fingerprints that differ in at most ``DISTANCE`` bits are equal
in at least ``BLOCKS - DISTANCE`` of them. Each fingerprint is keyed by every such choice of
blocks, those with the same key lie side by side after one sort, and only they are compared. Of the
links of a key a spanning forest is handed on, not all pairs, so a group of thousands of copies costs
as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from letterloom.llm.common import map_batches
from letterloom.llm.components import components, joined_roots
from letterloom.session import written

BITS = 64
BLOCKS = 5
DISTANCE = 3
SHINGLE_WORDS = 3
SEED = 42
# Members of one key that are compared with each other in one task; larger keys are cut further.
MAX_TOGETHER = 4096


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words.

    Only A to Z are lower-cased, and words are parted by the six ASCII white-space characters: both
    are what Python's ``bytes`` methods do.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle_words, len(words))
    starts = np.concatenate([[0], ends[: len(words) - size] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(starts)
    stops = ends[size - 1 :].tolist()
    for at in range(0, n, 1 << 16):  # bounded memory for texts of any length
        part = zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, digest, fp)`` of every row: ``fp`` is the fingerprint as a signed 64-bit number, ``digest`` a hash
    that tells texts under one key apart."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["key", "digest", "fp"])

    schema = StructType([rows.schema["key"], *StructType.fromDDL("digest bigint, fp bigint").fields])
    return map_batches(rows, run, schema)


def block_masks(bits: int = BITS, blocks: int = BLOCKS, distance: int = DISTANCE, within: int = (1 << BITS) - 1) -> list[int]:
    """A mask for each choice of ``blocks - distance`` blocks of the bits of ``within``."""
    places = [i for i in range(bits) if within >> i & 1]
    cuts = [len(places) * b // blocks for b in range(blocks + 1)]
    parts = [sum(1 << i for i in places[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def near_links(prints: DataFrame, distance: int = DISTANCE, max_together: int = MAX_TOGETHER) -> DataFrame:
    """``(a, b)``: links that join all distinct fingerprints of ``prints`` (column ``fp``) within ``distance`` bits.

    ``prints`` should be a written table: it is read again for each use. Every pair within the distance is
    connected by the links of one key. A key with more than
    ``max_together`` members is cut by one more block of its other bits (again one of which must be
    equal), as often as needed, so no task meets an unbounded key and no pair is lost.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(distance=distance, blocks=distance + 2)])
    keyed = prints.select("fp", F.explode(masks).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    if max_together < 1 << (distance + 1):
        raise ValueError("keys with so few free bits cannot be cut further")
    links = None
    while True:
        sizes = keyed.groupBy("mask", "part").agg(F.count("*").alias("n")).where(F.col("n") > max_together)
        large = written(sizes.drop("n"), "simhash-large")
        small = keyed if large.isEmpty() else keyed.join(large, ["mask", "part"], "left_anti")
        found = _links_of_keys(small, distance)
        links = found if links is None else links.unionByName(found)
        if small is keyed:
            return links
        # two keys may be cut to the same finer one
        keyed = written(_cut_keys(keyed.join(large, ["mask", "part"], "left_semi"), distance).distinct(), "simhash-keys")


def _cut_keys(keyed: DataFrame, distance: int) -> DataFrame:
    """The rows under finer keys: the bits outside the mask in ``distance + 1`` blocks, one of them added."""

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, masks = (np.array(batch.column(n)).view(np.uint64) for n in ("fp", "mask"))
            out = []
            for mask in np.unique(masks):
                rest = ~int(mask) & ((1 << BITS) - 1)
                some = fps[masks == mask]
                for more in block_masks(blocks=distance + 1, distance=distance, within=rest) if rest else []:
                    wide = np.full(len(some), int(mask) | more, np.uint64)
                    out.append(pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (some, wide, some & wide)], ["fp", "mask", "part"]))
            yield from out

    return map_batches(keyed.select("fp", "mask", "part"), finer, "fp bigint, mask bigint, part bigint")


def _links_of_keys(keyed: DataFrame, distance: int) -> DataFrame:
    """Links within each key. Rows of one key are neighbours after the sort; a batch is compared with itself
    shifted by 1, 2, ... places, for all keys at once, and rows of a key that goes on are kept for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([kept, np.stack([np.array(batch.column(n)) for n in ("mask", "part", "fp")])], axis=1)
            ends = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])) if rows.shape[1] else []
            cut = ends[-1] + 1 if len(ends) else 0
            yield from _forest(rows[:, :cut], distance)
            kept = rows[:, cut:]
        yield from _forest(kept, distance)

    rows = keyed.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
    return map_batches(rows, run, "a bigint, b bigint")


def _forest(rows: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links within each run of equal (mask, part)."""
    n = rows.shape[1]
    if n < 2:
        return
    fresh = np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(0)])
    first = np.flatnonzero(fresh)
    ends = np.repeat(np.concatenate([first[1:], [n]]), np.diff(np.concatenate([first, [n]])))
    fps, root = rows[2].view(np.uint64), np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    here = np.flatnonzero(ends - np.arange(n) > 1)
    shift = 1
    while len(here):
        there = here + shift
        close = np.bitwise_count(fps[here] ^ fps[there]) <= distance
        if close.any():
            out.append(joined_roots(root, here[close], there[close]))
            while len(out[-1][0]) and (root != root[root]).any():
                root = root[root]
        shift += 1
        here = here[ends[here] - here > shift]
    a, b = (np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in (0, 1))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(rows[2][a]), pa.array(rows[2][b])], ["a", "b"])


def grouped(docs: DataFrame, key: str, text: str, distance: int = DISTANCE) -> DataFrame:
    """``(key, digest, fp, root, component_id)`` of every row; ``root`` names the group by a fingerprint."""
    rows = written(fingerprints(docs, key, text), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("key").alias("least")), "simhash-classes")
    roots = components(near_links(classes.select("fp"), distance))
    of_root = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = written(of_root, "simhash-roots")
    # every member of a component of fingerprints gets the least key of all of them
    least = written(of_root.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = written(of_root.select("fp", "root").join(least, "root"), "simhash-named")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``(key, fingerprint, component_id)``: each row with its fingerprint and the least key it is linked to.

    Equal fingerprints are links too, so texts without words (null, empty, blank) form one group. A group of
    any size is one distinct fingerprint before anything is compared. Rows with a null key are fingerprinted
    and link others, but name no group: ``component_id`` is null only where all keys of the group are null.
    Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return grouped(docs, key, text, distance).select(F.col("key").alias(key), digits, "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least key (null last), then hash.

    Texts without words (null, empty, blank) are one group. Rows repeated in key and text are one row; all columns are kept, whatever
    their names; an empty table gives no rows.
    """
    first = F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "digest"))
    kept = written(grouped(docs, key, text).groupBy("root").agg(first.alias("first")).select("first.key", "first.digest"), "simhash-kept")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("own_key"), F.xxhash64(docs[text]).alias("own_digest"))
    same = own["own_key"].eqNullSafe(kept["key"]) & (own["own_digest"] == kept["digest"])
    # rows that are repeated in full, or in key and text: one of them
    nth = F.row_number().over(Window.partitionBy("own_key", "own_digest").orderBy("own_digest"))
    return own.join(kept, same, "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")
