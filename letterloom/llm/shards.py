"""Lookups in written token shards: the token at a place, how often a token occurs, and where.

Shards are rows of :func:`letterloom.llm.tokens.token_shards`, written and read again. Each lookup reads
the wavelet matrices where they lie, a shard at a time; ids are never laid out as rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from letterloom.llm.common import map_batches
from letterloom.llm.tokens import SHARD_TOKENS, shard_starts
from letterloom.llm.wavelet import WaveletMatrix
from letterloom.session import written

# Places of one shard that travel in one row.
PLACES_TOGETHER = 4096


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, WaveletMatrix]]:
    """The rows one after another, each with its payload as a matrix."""
    for batch in batches:
        for row in range(batch.num_rows):
            own = {name: batch.column(name)[row] for name in batch.schema.names}
            yield own, WaveletMatrix.from_bytes(own.pop("payload").as_py())


def tokens_at(shards: DataFrame, places: DataFrame, place: str = "place", cell: int = SHARD_TOKENS) -> DataFrame:
    """``(place, token)``: the id at each place of the whole sequence, counted from 0.

    Each row of ``places`` gives one row, repeated ones too; null places and those outside the sequence have a null
    token. Places find their shard by cells of ``cell`` ids that both lie in, so nothing is joined with everything;
    only shards that are asked for are unpacked.
    """
    asked = written(places.select(F.col(place).cast("long").alias("place")), "shard-places")
    starts = written(shard_starts(shards).join(shards.select("part", "seq", "tokens"), ["part", "seq"]), "shard-starts")
    cells = F.sequence(F.floor(F.col("before") / cell), F.floor((F.col("before") + F.col("tokens") - 1) / cell))
    met = starts.where("tokens > 0").withColumn("cell", F.explode(cells))
    some = asked.where("place >= 0").distinct().withColumn("cell", F.floor(F.col("place") / cell)).join(met, "cell")
    some = some.where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("tokens")))
    own = some.select("part", "seq", (F.col("place") - F.col("before")).alias("own"), "before")
    together = own.groupBy("part", "seq", "before", F.floor(F.col("own") / PLACES_TOGETHER).alias("run")).agg(F.collect_list("own").alias("owns"))
    rows = together.join(shards.select("part", "seq", "payload"), ["part", "seq"]).select("before", "owns", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, matrix in _matrices(batches):
            at = own["owns"].values.to_numpy()
            found = pa.array([matrix.access(int(i)) for i in at], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at + own["before"].as_py()), found], ["place", "token"])

    return asked.join(map_batches(rows, run, "place bigint, token bigint"), "place", "left").withColumnRenamed("place", place)


def _wanted(ids: Iterable[int]) -> list[int]:
    """Distinct ids; a batch is bounded by the vocabulary."""
    return sorted({int(i) for i in ids})


def token_counts(shards: DataFrame, ids: Iterable[int]) -> DataFrame:
    """``(token, count)`` of each distinct id over all shards, by two ranks a bit in each; an id that never occurs has 0."""
    wanted = _wanted(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for _, matrix in _matrices(batches):
            total += [matrix.count(token) for token in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(total)], ["token", "count"])

    asked = shards.sparkSession.createDataFrame([(i,) for i in wanted], "token bigint")
    counted = map_batches(shards.select("payload"), run, "token bigint, count bigint").groupBy("token").agg(F.sum("count").alias("count"))
    return asked.join(counted, "token", "left").select("token", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def occurrences(shards: DataFrame, ids: Iterable[int], key: str = "doc_id") -> DataFrame:
    """``(token, place, key, at)``: every occurrence of the given ids in the whole sequence, with the key of its document and
    its place there, both counted from 0. Repeated ids count once, those that never occur give no rows; a row of a
    document's end holds the end id. Rows leave a task shard by shard.
    """
    wanted = _wanted(ids)
    kind = shards.schema["keys"].dataType.elementType
    schema = StructType([*StructType.fromDDL("token bigint, part int, seq int, own bigint").fields, StructField("key", kind), *StructType.fromDDL("at bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, matrix in _matrices(batches):
            ends = np.cumsum(own["lengths"].values.to_numpy())
            starts = np.concatenate([[0], ends[:-1]])
            for token in wanted:
                found = matrix.occurrences(token).astype(np.int64)
                document = np.searchsorted(ends, found, side="right")
                columns = [
                    pa.array(np.full(len(found), token, np.int64)),
                    pa.array(np.full(len(found), own["part"].as_py(), np.int32)),
                    pa.array(np.full(len(found), own["seq"].as_py(), np.int32)),
                    pa.array(found),
                    own["keys"].values.take(pa.array(document)),
                    pa.array(found - starts[document]),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    rows = map_batches(shards.select("part", "seq", "keys", "lengths", "payload"), run, schema)
    placed = rows.join(shard_starts(shards), ["part", "seq"])
    return placed.select("token", (F.col("own") + F.col("before")).alias("place"), F.col("key").alias(key), "at")
