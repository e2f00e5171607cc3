"""How two tokenizers cut the same texts: links between tokens that end together, counted over the corpus.

Both tokenizers part a text before every single space and line end, so a text is aligned piece by piece, and a
piece once for all its occurrences in a worker. Documents are numbered inside blocks. A pair of
ids (a token of A and one of B that end at the same byte) has in each block a compressed bitmap of the documents that hold it,
and multiplicity planes: plane j holds the documents in which the pair stands ``1 + k`` times with bit j of ``k`` set. Document
counts are the popcounts of the bitmaps, link counts those of bitmaps and planes by their weight, summed over
blocks. Pairs with their counts then meet their postings again, and each block adds up what its documents get.

A hot pair costs a bitmap a block, not a row a document.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from letterloom.llm.common import map_batches
from letterloom.llm.tokens import distinct_pieces, gathered, odd_spaces
from letterloom.session import written

VOCABULARY_A = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY_B = public_tokenizers.path("piece_bpe_32k.model")
# Documents of a block, numbered from 0: their numbers take two bytes.
BLOCK_DOCS = 4096
# Texts that are aligned at once; what they link is merged into the block's bitmaps.
TEXTS_TOGETHER = 1024
# Pieces whose alignment a Python worker remembers; it forgets them all when there are more.
KNOWN_PIECES = 300_000
# Pieces that are encoded as one string.
JOINED = 20_000
_SPACE = "▁"  # what B writes for a space; a text that holds it reads back differently


class PieceAligner:
    """Token ids of both tokenizers and their common ends, by piece."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        own = {i: t for t, i in self.a.get_vocab().items()}
        byte_of = _byte_alphabet()
        self.bytes_a = [bytes(byte_of.get(c, 0) for c in own.get(i, "")) for i in range(max(own, default=-1) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        single = [self.b.is_byte(i) for i in range(len(pieces))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if one else p.replace(_SPACE, " ").encode() for p, one in zip(pieces, single, strict=True)]
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.lead = self.b.encode("x")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []  # of each known piece, as text
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.pairs: list[bytes] = []  # a << 32 | b of each link

    def aligned(self, pieces: list[str]) -> list[tuple[int, int, str, bytes] | None]:
        """Tokens of A, tokens of B, groups as text and pairs of each piece; None where the tokens do not read back as the piece.

        Joined, the pieces must part again at their ends, as those that start with a space or line end and hold another character do;
        the first starts with a space, which B adds by itself.
        """
        if not pieces:
            return []
        text = "".join(pieces)
        raw = text.encode()
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(text[1:]) if text[0] == " " and len(text) > 1 else self.b.encode("x" + text)[len(self.lead) :], np.int64)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            return [None] if len(pieces) == 1 else [x for p in pieces for x in self.aligned([p])]
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        stop_a, stop_b = np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1
        pairs = a[stop_a - 1] << 32 | b[stop_b - 1]
        stops = np.searchsorted(both, np.cumsum([len(p.encode()) for p in pieces])) + 1
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, x, y = [], 0, 0
        for i, j in zip(stop_a.tolist(), stop_b.tolist(), strict=True):
            groups.append(f"{','.join(text_a[x:i])}|{','.join(text_b[y:j])}")
            x, y = i, j
        out: list[tuple[int, int, str, bytes] | None] = []
        data = pairs.tobytes()
        first, x, y = 0, 0, 0
        counts_a, counts_b = stop_a[stops - 1].tolist(), stop_b[stops - 1].tolist()
        for stop, i, j in zip(stops.tolist(), counts_a, counts_b, strict=True):
            out.append((i - x, j - y, ";".join(groups[first:stop]), data[8 * first : 8 * stop]))
            first, x, y = stop, i, j
        return out

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The pieces' places among the known ones; -1 for those that do not read back."""
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        known = self.known
        fresh = [p for p in pieces if p not in known]
        joinable = sorted((p for p in fresh if len(p) > 1), key=lambda p: p[0] != " ")
        for some in [*(joinable[i : i + JOINED] for i in range(0, len(joinable), JOINED)), *([p] for p in fresh if len(p) == 1)]:
            for piece, found in zip(some, self.aligned(some), strict=True):
                if found is None:
                    known[piece] = -1
                    continue
                known[piece] = len(self.groups)
                for own, value in zip((self.n_a, self.n_b, self.groups, self.pairs), found, strict=True):
                    own.append(value)
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def align(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text, led by a space: tokens of A and of B, and its groups as text (nothing where the tokens do not read
        back); then the place of a text and a pair for every link of all texts."""
        texts = pc.fill_null(texts, "")
        odd = odd_spaces(pc.binary_join_element_wise(" ", texts, ""))
        apart = pc.or_(odd, pc.match_substring(texts, _SPACE)).to_numpy(zero_copy_only=False)
        n_a, n_b, groups = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [""] * len(texts)
        docs, pairs = [], []
        for at in np.flatnonzero(apart).tolist():
            text = texts[at].as_py()
            found = None if _SPACE in text else self.aligned([" " + text])[0]
            if found:
                n_a[at], n_b[at], groups[at], own = found
                pairs.append(np.frombuffer(own, np.int64))
                docs.append(np.full(len(pairs[-1]), at))
        places = np.flatnonzero(~apart & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        if not len(places):
            return n_a, n_b, groups, *(np.concatenate([np.empty(0, np.int64), *x]) for x in (docs, pairs))
        counts, distinct, which = distinct_pieces(pc.binary_join_element_wise(" ", texts.take(pa.array(places)), ""))
        numbers = self.numbers(distinct)
        bad = np.add.reduceat(numbers[which] < 0, np.cumsum(counts) - counts) > 0
        places, doc = places[~bad], np.repeat(places, counts)
        which = which[np.repeat(~bad, counts)]
        doc, counts = np.repeat(places, counts[~bad]), counts[~bad]
        known = numbers.tolist()
        texts_of = [self.groups[k] for k in known]
        own = [self.pairs[k] for k in known]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 8
        linked, _ = gathered(np.frombuffer(b"".join(own), np.int64), sizes, which)
        pairs.append(linked)
        docs.append(np.repeat(doc, sizes[which]))
        for total, each in ((n_a, self.n_a), (n_b, self.n_b)):
            sums = np.concatenate([[0], np.cumsum(np.array(each)[numbers][which])])
            stops = np.cumsum(counts)
            total[places] = sums[stops] - sums[stops - counts]
        order, at = which.tolist(), 0
        for place, n in zip(places.tolist(), counts.tolist(), strict=True):
            groups[place] = ";".join([texts_of[k] for k in order[at : at + n]])
            at += n
        return n_a, n_b, groups, np.concatenate(docs), np.concatenate(pairs)


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: its own code if that is below 256, else, in
    ascending order, the bytes that no such character stands for."""
    alphabet = sorted(ByteLevel.alphabet())
    own = {c: ord(c) for c in alphabet if ord(c) < 256}
    rest = [b for b in range(256) if chr(b) not in own]
    return own | dict(zip((c for c in alphabet if c not in own), rest, strict=True))


@cache
def _aligner(path_a: str, path_b: str) -> PieceAligner:
    """The Python worker's aligner; the files must be on every machine."""
    return PieceAligner(path_a, path_b)


# Postings


def _held(docs: np.ndarray, pairs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pair and document, and how often the pair stands in it."""
    distinct, number = np.unique(pairs, return_inverse=True)
    both, times = np.unique(number * n_docs + docs, return_counts=True)
    return distinct[both // n_docs], (both % n_docs).astype(np.uint16), times.astype(np.int32)


def _planes(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_docs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Of one block: plane, pairs, popcounts and compressed bitmaps; plane 0 holds the documents, plane ``1 + j`` bit j of
    how often more than once the pair stands in them. What parts of the block hold is merged: their documents ascend."""
    pairs, docs, times = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(pairs, kind="stable")
    pairs, docs, more = pairs[order], docs[order], times[order] - 1
    for plane in range(1 + int(more.max(initial=0)).bit_length()):
        keep = more >> (plane - 1) & 1 == 1 if plane else np.ones(len(more), bool)
        own, docs_of = pairs[keep], docs[keep]
        if not len(own):
            continue
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts = np.diff(np.append(first, len(own)))
        yield plane, own[first], counts, _bitmaps(docs_of, first, counts, n_docs)


def _bitmaps(docs: np.ndarray, first: np.ndarray, counts: np.ndarray, n_docs: int) -> pa.Array:
    """Each run of ascending document numbers as two-byte numbers, or as one bit a document where that is shorter."""
    dense_size = -(-n_docs // 8)
    dense = counts * 2 > dense_size
    sizes = np.where(dense, dense_size, counts * 2)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(offsets[-1], np.uint8)
    sparse = np.repeat(~dense, counts)
    data[np.repeat(~dense, sizes)] = docs[sparse].astype("<u2").view(np.uint8)
    for at in np.flatnonzero(dense).tolist():
        ones = np.zeros(n_docs, bool)
        ones[docs[first[at] : first[at] + counts[at]]] = True
        data[offsets[at] : offsets[at + 1]] = np.packbits(ones, bitorder="little")
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _documents_in(counts: np.ndarray, bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and document number of every one in the bitmaps."""
    sizes = pc.binary_length(bitmaps).to_numpy(zero_copy_only=False)
    start = bitmaps.offset
    offsets = np.frombuffer(bitmaps.buffers()[1], np.int32)[start : start + len(bitmaps) + 1]
    data = np.frombuffer(bitmaps.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sparse = sizes == counts * 2
    rows = [np.repeat(np.flatnonzero(sparse), counts[sparse])]
    docs = [np.ascontiguousarray(data[np.repeat(sparse, sizes)]).view("<u2").astype(np.int64)]
    for at in np.flatnonzero(~sparse).tolist():
        own = np.flatnonzero(np.unpackbits(data[offsets[at] - offsets[0] : offsets[at + 1] - offsets[0]], bitorder="little"))
        rows.append(np.full(len(own), at))
        docs.append(own)
    return np.concatenate(rows), np.concatenate(docs)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """Rows of two kinds, by block. Documents: ``at`` (number in the block), ``key, n_a, n_b, n_groups, groups_sha256``. Postings
    (``at`` is null): ``a, b`` (ids), ``plane``, ``n`` (its popcount), ``docs`` (its bitmap)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    own = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, a int, b int, plane int, n int, docs binary"
    schema = StructType([*StructType.fromDDL("block bigint, at int").fields, StructField("key", rows.schema["key"].dataType), *StructType.fromDDL(own).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = _aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in (b.slice(at, BLOCK_DOCS) for b in batches for at in range(0, b.num_rows, BLOCK_DOCS)):
            size = batch.num_rows
            held = []
            for start in range(0, size, TEXTS_TOGETHER):
                part = batch.slice(start, TEXTS_TOGETHER)
                n_a, n_b, groups, docs, pairs = aligner.align(part.column("text"))
                shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                named = {
                    "at": pa.array(np.arange(start, start + part.num_rows, dtype=np.int32)),
                    "key": part.column("key"),
                    "n_a": pa.array(n_a),
                    "n_b": pa.array(n_b),
                    "n_groups": pa.array(np.bincount(docs, minlength=part.num_rows)),  # every group ends with one link
                    "groups_sha256": pa.array(shas, pa.string()),
                }
                yield _rows(block, part.num_rows, named, part.schema.field("key").type)
                if len(pairs):
                    held.append(_held(docs + start, pairs, size))
            for plane, ids, counts, bitmaps in _planes(held, size) if held else ():
                posted = {
                    "a": pa.array((ids >> 32).astype(np.int32)),
                    "b": pa.array((ids & 0xFFFFFFFF).astype(np.int32)),
                    "plane": pa.array(np.full(len(ids), plane, np.int32)),
                    "n": pa.array(counts.astype(np.int32)),
                    "docs": bitmaps,
                }
                yield _rows(block, len(ids), posted, batch.schema.field("key").type)
            block += 1

    return map_batches(rows, run, schema)


def _rows(block: int, n: int, columns: dict[str, pa.Array], key: pa.DataType) -> pa.RecordBatch:
    """``n`` rows of a block; columns that are not given are null."""
    kinds = [("at", pa.int32()), ("key", key), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]
    kinds += [(c, pa.int32()) for c in ("a", "b", "plane", "n")] + [("docs", pa.binary())]
    arrays = [columns.get(name, pa.nulls(n, kind)) for name, kind in kinds]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *arrays], ["block", *(name for name, _ in kinds)])


def pair_counts(posted: DataFrame) -> DataFrame:
    """``a, b, n_docs, n_links, best``: in how many documents a pair is linked, by how many links, and whether no other pair
    of its B id has more."""
    weight = F.expr("case plane when 0 then 1L else shiftleft(1L, plane - 1) end")
    counts = posted.where("at is null").groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("n_docs"), F.sum(F.col("n") * weight).alias("n_links")
    )
    counts = written(counts, "alignment-pairs")
    most = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    return counts.join(most, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def _scores(posted: DataFrame, counts: DataFrame) -> DataFrame:
    """``block, at, n_best, count_sum``: what the counts of its links give each document that has any."""
    rows = posted.where("at is null").select("block", "a", "b", "plane", "n", "docs")
    rows = rows.join(counts.select("a", "b", "n_links", "best"), ["a", "b"]).drop("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, BLOCK_DOCS), np.int64)

        def out() -> pa.RecordBatch:
            own = np.flatnonzero(sums[1])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), now)), pa.array(own.astype(np.int32)), pa.array(sums[0][own]), pa.array(sums[1][own])],
                ["block", "at", "n_best", "count_sum"],
            )

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                if now is not None and blocks[start] != now:
                    yield out()
                    sums[:] = 0
                now = blocks[start]
                part = batch.slice(start, stop - start)
                plane = part.column("plane").to_numpy()
                times = np.left_shift(1, np.maximum(plane - 1, 0).astype(np.int64))
                row, doc = _documents_in(part.column("n").to_numpy(), part.column("docs"))
                np.add.at(sums[0], doc, (times * part.column("best").to_numpy(zero_copy_only=False))[row])
                np.add.at(sums[1], doc, (times * part.column("n_links").to_numpy())[row])
        if now is not None:
            yield out()

    rows = rows.repartition("block").sortWithinPartitions("block")
    return map_batches(rows.select("block", "plane", "n", "docs", "n_links", "best"), run, "block bigint, at int, n_best bigint, count_sum bigint")


def alignment_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    Tokens of A and B link where their bytes end together. Neither vocabulary has an empty token, so a group ends with one link and
    ``n_links`` is ``n_groups``. Null and empty texts, and texts that either tokenizer does not read back,
    have zeros and no digest. Repeated rows and null keys each get a row and count for themselves; other columns are not
    read; an empty table gives no rows.
    """
    posted = written(postings(docs, key, text), "alignment-postings")
    counts = written(pair_counts(posted), "alignment-counts")
    scores = _scores(posted, counts)
    rows = posted.where("at is not null").select("block", "at", "key", "n_a", "n_b", "n_groups", "groups_sha256")
    nothing = F.lit(0).cast("long")
    return rows.join(scores, ["block", "at"], "left").select(
        F.col("key").alias(key),
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", nothing).alias("n_best"),
        F.coalesce("count_sum", nothing).alias("count_sum"),
        "groups_sha256",
    )
