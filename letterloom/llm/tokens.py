"""Token ids of texts in binary shards: one wavelet matrix per shard, in the order of the documents.

A shard is one row of a table in the shared folder: its place (``part``, ``seq``), the keys of its
documents, their lengths and the wavelet matrix of all their ids. Shards hold about ``SHARD_TOKENS``
ids and whole documents.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from tokenizers import Tokenizer

from letterloom.llm.common import map_batches
from letterloom.llm.wavelet import WaveletMatrix
from letterloom.session import written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
SHARD_TOKENS = 1 << 18
# Pieces whose ids a Python worker remembers (about 150 MB); of more, it keeps those of the texts at hand.
KNOWN_PIECES = 700_000
# Signs that are known apart from the word that they end.
END_SIGNS = ".,;:!?%&#$*"
# Texts that are cut into pieces at once.
TEXTS_TOGETHER = 2048

# Two white-space characters side by side, or the character that pieces are parted by.
_ODD = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2}|\x00"
# A letter or digit that no version of Unicode takes for anything else.
_WORD_END = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]\z"


class PieceEncoder:
    """Ids of texts through the ids of their distinct pieces.

    The vocabulary's pre-tokenizer never joins what a single space or line end parts from the text before
    it, so a text's ids are those of its pieces (a space or line end and what follows), one after another.
    Texts with two white-space characters in a row are encoded whole. A special token's literal holds neither
    space nor line end, so it lies within one piece. Nor does the pre-tokenizer join a letter or digit with the
    signs after it, so a piece that signs end is two, unless a special token's literal holds such signs or the
    pre-tokenizer does join them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        top = max(vocabulary.values(), default=0)
        self.bits = max(1, top.bit_length())
        self.dtype = np.uint16 if top < 1 << 16 else np.uint32
        # every character of a byte-level token stands for one byte
        self.token_bytes = np.zeros(top + 1, np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)
        self.known: dict[str, bytes] = {}
        literals = "".join(token.content for token in self.tokenizer.get_added_tokens_decoder().values())
        pre = self.tokenizer.pre_tokenizer
        self.end_signs = "".join(c for c in END_SIGNS if pre and c not in literals and all(len(pre.pre_tokenize_str(x + c)) == 2 for x in "a1"))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        known = self.known
        joinable = [p for p in pieces if len(p) > 1 and p[0] in " \n"]
        others = [p for p in pieces if not (len(p) > 1 and p[0] in " \n")]
        for p, ids in zip(others, self._whole(others), strict=True):
            known[p] = ids.tobytes()
        for at in range(0, len(joinable), 50_000):
            some = joinable[at : at + 50_000]
            ids = self._whole(["".join(some)])[0]
            ends = np.cumsum(pc.binary_length(pa.array(some)).to_numpy().astype(np.int64))
            cuts = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1
            places = np.concatenate([[0], cuts * self.dtype(0).itemsize]).astype(np.int32)
            runs = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(places), pa.py_buffer(ids)])
            known.update(zip(some, runs.to_numpy(zero_copy_only=False), strict=True))

    def _codes(self, distinct: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.known) > KNOWN_PIECES:
            self.known = {p: self.known[p] for p in distinct if p in self.known}
        known = self.known
        codes = list(map(known.get, distinct))
        self._learn([p for p, ids in zip(distinct, codes, strict=True) if ids is None])
        return [known[p] if ids is None else ids for p, ids in zip(distinct, codes, strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none)."""
        texts = pc.fill_null(texts, "")
        odd = odd_spaces(texts)
        whole = iter(self._whole(texts.filter(odd).to_pylist()))
        even = iter(self._by_pieces(texts.filter(pc.invert(odd))))
        return [next(whole if o else even) for o in odd.to_pylist()]

    def _by_pieces(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        counts, coded = coded_pieces(texts)
        halves, which = self._halves(coded.dictionary)
        codes = self._codes(halves)
        pool = np.frombuffer(b"".join(codes), self.dtype)
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // self.dtype(0).itemsize
        pool, ends = gathered(pool, sizes, which)
        ids, ends = gathered(pool, np.diff(ends[::2]), coded.indices.to_numpy(zero_copy_only=False))
        return np.split(ids, ends[np.cumsum(counts)[:-1]])

    def _halves(self, pieces: pa.Array) -> tuple[list[str], np.ndarray]:
        """Distinct words and ends of pieces, and which two of them make up each piece, one pair after another.
        The end is empty unless only signs stand after the last letter or digit."""
        words = pc.utf8_rtrim(pieces, characters=self.end_signs)
        cut = pc.and_(pc.not_equal(words, pieces), pc.match_substring_regex(words, _WORD_END))
        words = pc.if_else(cut, words, pieces).dictionary_encode()
        # pieces hold no \x00; it keeps the class from being empty
        ends = pc.replace_substring_regex(pieces.filter(cut), rf"(?s)^.*[^\x00{re.escape(self.end_signs)}]", "").dictionary_encode()
        which = np.zeros((len(pieces), 2), np.int64)
        which[:, 0] = words.indices.to_numpy(zero_copy_only=False)
        which[:, 1] = len(words.dictionary)
        which[cut.to_numpy(zero_copy_only=False), 1] += 1 + ends.indices.to_numpy(zero_copy_only=False)
        return [*words.dictionary.to_numpy(zero_copy_only=False), "", *ends.dictionary.to_numpy(zero_copy_only=False)], which.ravel()


def odd_spaces(texts: pa.Array) -> pa.Array:
    """Whether a text has two white-space characters in a row, or the character that pieces are parted by."""
    return pc.match_substring_regex(texts, _ODD)


def distinct_pieces(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """How many pieces each text has, the distinct pieces, and which of them follow one another in all texts.

    A piece ends before each space and line end; the texts must not be odd. An empty text has none.
    """
    counts, coded = coded_pieces(texts)
    return counts, coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)


def coded_pieces(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many pieces each text has, and the pieces of all texts with their dictionary."""
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n")
    lists = pc.split_pattern(marked, "\x00")
    flat = lists.flatten()
    some = pc.not_equal(flat, "")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    # nothing stands before a first space or line end
    counts -= ~some.to_numpy(zero_copy_only=False)[np.cumsum(counts) - counts]
    return counts, flat.filter(some).dictionary_encode()


def gathered(pool: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` (of the given sizes) in the order ``which``, and where each ends, from a leading 0 on."""
    starts = np.cumsum(sizes) - sizes
    lengths = sizes[which]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return pool[np.repeat(starts[which] - ends[:-1], lengths) + np.arange(ends[-1])], ends


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The Python worker's encoder for a vocabulary file; the file must be on every machine."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def token_shards(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str = VOCABULARY,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Shards of all texts in ascending order of key: ``part, seq, keys, lengths, tokens, payload``.

    Rows are dealt out by ranges of key (rows of one key by their texts' hash), so the order of the shards
    is the order of the documents and any number of them can be written at once. Null keys come first, rows
    of one key in an order that their texts fix; a null text is empty and has only the end id.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ranges = ["key", F.xxhash64("text")]  # bounds are sampled to the driver, so no texts among them
    kind = rows.schema["key"].dataType
    schema = StructType(
        [
            *StructType.fromDDL("part int, seq int").fields,
            StructField("keys", ArrayType(kind)),
            *StructType.fromDDL("lengths array<bigint>, tokens bigint, payload binary").fields,
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            flat = np.concatenate([x for one in ids for x in (one, end)])
            payload = WaveletMatrix.of(flat, coder.bits).to_bytes()
            own = pa.concat_arrays(keys)
            columns = [
                pa.array([part], pa.int32()),
                pa.array([seq], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                pa.array([[len(x) + 1 for x in ids]], pa.list_(pa.int64())),
                pa.array([len(flat)], pa.int64()),
                pa.array([payload], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        end, held = np.array([end_id], coder.dtype), 0
        for batch in (b.slice(at, TEXTS_TOGETHER) for b in batches for at in range(0, b.num_rows, TEXTS_TOGETHER)):
            first = 0
            for i, one in enumerate(coder.encode(batch.column(1))):
                ids.append(one)
                held += len(one) + 1
                if held >= shard_tokens:
                    keys.append(batch.column(0)[first : i + 1])
                    yield shard()
                    keys, ids, held, first, seq = [], [], 0, i + 1, seq + 1
            keys.append(batch.column(0)[first:])
        if ids:
            yield shard()

    return map_batches(rows.repartitionByRange(*ranges).sortWithinPartitions(*ranges, "text"), run, schema)


def shard_starts(shards: DataFrame) -> DataFrame:
    """``(part, seq, before)``: ids in all earlier shards. Sums run within a part, then over the parts' totals
    (a row for each task that wrote shards), so no task meets all shards."""
    sizes = shards.select("part", "seq", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("parts_before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("own_before", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return sizes.join(parts, "part").select("part", "seq", (F.col("own_before") + F.col("parts_before")).alias("before"))


def read_documents(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every document, from the shards alone."""
    kind = shards.schema["keys"].dataType.elementType
    schema = StructType([StructField("key", kind), *StructType.fromDDL("part int, seq int, own bigint, n_tokens bigint, ids_crc32 bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, keys, lengths, payload = (batch.column(n)[row] for n in ("part", "seq", "keys", "lengths", "payload"))
                matrix = WaveletMatrix.from_bytes(payload.as_py())
                ids = matrix.ids(np.uint16 if matrix.bits <= 16 else np.uint32).astype("<u4")
                sizes = lengths.values.to_numpy()
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(x) for x in np.split(ids, ends[:-1])]
                n = len(sizes)
                columns = [
                    keys.values,
                    pa.array(np.full(n, part.as_py(), np.int32)),
                    pa.array(np.full(n, seq.as_py(), np.int32)),
                    pa.array(ends - sizes),
                    pa.array(sizes),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    rows = map_batches(shards.select("part", "seq", "keys", "lengths", "payload"), run, schema)
    found = rows.join(shard_starts(shards), ["part", "seq"])
    return found.select(F.col("key").alias(key), (F.col("own") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Write the shards of ``documents`` to the shared folder and return what their files hold of each document.

    One row per row of ``docs``, also for null keys, null or empty texts and repeated rows; other columns are not
    read; an empty table gives no rows.
    """
    return read_documents(written(token_shards(docs, path=path), "token-shards"))
