"""Exact top-k search by inner product over a vector-approximation file.

Each component becomes an integer and each integer a cell of a coarse grid. A scan of the cells alone
bounds every score from below and above; only vectors whose upper bound reaches the kth best lower
bound can be results, and of those the exact vectors are read from the best bound on: first a few
per query, then those whose bound still reaches the kth exact score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from heapq import nsmallest
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterloom.llm.common import map_batches
from letterloom.session import written

TOP_K = 5
QUERY_EVERY = 50
SCALE = 256.0
CELLS = 64
# Distinct vectors and queries that one task compares.
SLICE_ROWS = 4096
QUERY_ROWS = 1024
# Exact vectors read first, for each query.
FIRST_READS = 12
_LARGEST = 2**31 - 1
# Bounds further out are the least and the greatest long.
_FAR = 2.0**62


def integer_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, dim, wide, low, high, payload)``: floor(256 x) of each component, as little-endian 32-bit integers, or as
    text where one of them takes more bits (``wide``). Null keys and vectors, and null or non-finite components, are left out."""
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = vector.values
                if values.null_count or not np.isfinite(values.to_numpy()).all():
                    continue
                if (np.abs(values.to_numpy()) < _LARGEST / SCALE).all():
                    whole = np.floor(values.to_numpy() * SCALE).astype("<i4")
                    low, high = (int(whole.min()), int(whole.max())) if len(whole) else (0, 0)
                    out.append((key, len(whole), False, low, high, whole.tobytes()))
                else:
                    exact = ",".join(str(math.floor(Fraction(x) * int(SCALE))) for x in values.to_pylist())
                    out.append((key, len(values), True, 0, 0, exact.encode()))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            names = ["id", "dim", "wide", "low", "high", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return map_batches(rows, run, "id bigint, dim int, wide boolean, low bigint, high bigint, payload binary")


def _whole(payload: bytes, wide: bool) -> list[int]:
    return list(map(int, payload.split(b","))) if wide else np.frombuffer(payload, "<i4").tolist()


def _as_long(score: int) -> int:
    """The score, or the nearest long where it is beyond."""
    return max(-(1 << 63), min((1 << 63) - 1, score))


def _matrix(payloads: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(payloads.to_pylist()), kind).reshape(len(payloads), dim)


def _with_cells(rows: DataFrame) -> DataFrame:
    """``(cid, dim, cells)``: the approximation file; a byte per component, cells of ``width`` integers from ``low``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [
                ((np.frombuffer(p, "<i4").astype(np.int64) - low) // width).astype(np.uint8).tobytes()
                for p, low, width in zip(*(batch.column(n).to_pylist() for n in ("payload", "grid_low", "width")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], ["cid", "dim", "cells"])

    return map_batches(rows.select("cid", "dim", "payload", "grid_low", "width"), run, "cid bigint, dim int, cells binary")


def _scan(keep: int, levels: bool):
    """Bounds of all scores of a block of queries with a slice of cells: only each query's ``keep`` best lower ones
    (``levels``), or those whose upper one reaches the query's level."""

    def run(key: tuple, queries: pa.Table, slice_: pa.Table) -> pa.Table:
        names = ["qid", "cid", "lower", "upper"]
        empty = pa.table([pa.array([], pa.int64())] * 4, names=names)
        if not queries.num_rows or not slice_.num_rows:
            return empty
        dim = key[0].as_py()
        low, width = queries["grid_low"][0].as_py(), queries["width"][0].as_py()
        q = _matrix(queries["payload"], dim, "<i4").astype(np.float64)
        least = _matrix(slice_["cells"], dim, "u1").astype(np.float64) * width + low
        largest = max(abs(low), abs(low + CELLS * width))
        qids, cids = queries["qid"].to_numpy(), slice_["cid"].to_numpy()
        out = []
        for at in range(0, len(q), 128):
            some = q[at : at + 128]
            mid = some @ least.T
            # doubles are whole up to 2 ** 53; sums that may pass it are known up to a rounding error for each term
            sums = np.abs(some).sum(1) * largest
            error = np.where(sums < 2.0**52, 0.0, sums * 2.0**-51 * (dim + 2))[:, None]
            # a component adds (width - 1) * q at most or at least, as its sign says
            lower = np.clip(np.floor(mid + (np.minimum(some, 0).sum(1) * (width - 1))[:, None] - error), -_FAR, _FAR)
            upper = np.clip(np.ceil(mid + (np.maximum(some, 0).sum(1) * (width - 1))[:, None] + error), -_FAR, _FAR)
            if levels:
                n = min(keep, len(cids))
                j = np.argpartition(lower, len(cids) - n, axis=1)[:, len(cids) - n :].ravel()
                i = np.repeat(np.arange(len(some)), n)
            else:
                i, j = np.nonzero(upper >= queries["level"].to_numpy()[at : at + 128][:, None])
            down, up = lower[i, j], upper[i, j]
            down = np.where(down <= -_FAR, np.iinfo(np.int64).min, down.astype(np.int64))
            up = np.where(up >= _FAR, np.iinfo(np.int64).max, up.astype(np.int64))
            out.append((qids[at + i], cids[j], down, up))
        return pa.table([pa.array(np.concatenate([x[c] for x in out])) for c in range(4)], names=names)

    return run


def _wide_scan(keep: int):
    """The ``keep`` best classes of a slice for each query, in whole numbers of any size: all of them for a wide query, the
    wide ones for the others."""

    def run(key: tuple, queries: pa.Table, slice_: pa.Table) -> pa.Table:
        out: list[tuple[int, list[int], int]] = []
        classes = list(zip(*(slice_[c].to_pylist() for c in ("cid", "payload", "wide", "ids")), strict=True))
        whole = [_whole(payload, wide) for _, payload, wide, _ in classes]
        for qid, payload, wide in zip(*(queries[c].to_pylist() for c in ("qid", "payload", "wide")), strict=True):
            q = _whole(payload, wide)
            scores = [(-_as_long(sum(map(mul, q, own))), cid, ids) for (cid, _, w, ids), own in zip(classes, whole, strict=True) if w or wide]
            out += [(qid, ids, -score) for score, _, ids in nsmallest(keep, scores)]
        columns = list(zip(*out, strict=True)) or [()] * 3
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["qid", "ids", "score"])

    return run


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    """Exact inner product; in Python's whole numbers where 64 bits might not do."""
    if len(a) and float(np.abs(a).max()) * float(np.abs(b).max()) * len(a) >= 2.0**62:
        return _as_long(sum(map(mul, a.tolist(), b.tolist())))
    return int(np.dot(a, b))


def _exact(pairs: DataFrame) -> DataFrame:
    """``(qid, ids, score)`` of pairs that carry both exact vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(n).to_pylist() for n in ("query", "payload"))
            scores = [_dot(np.frombuffer(x, "<i4").astype(np.int64), np.frombuffer(y, "<i4").astype(np.int64)) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.int64())], ["qid", "ids", "score"])

    return map_batches(pairs.select("qid", "ids", "query", "payload"), run, "qid bigint, ids array<bigint>, score bigint")


def _wide_scores(queries: DataFrame, classes: DataFrame, keep: int) -> DataFrame:
    """``(qid, ids, score)``: the best classes of each slice wherever the query or the class is wide."""
    sizes = classes.groupBy("dim").agg(F.ceil(F.count("*") / SLICE_ROWS).alias("slices"))
    sizes = written(sizes.join(classes.where("wide").select("dim").distinct(), "dim"), "vector-wide")
    left = queries.join(sizes, "dim").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    left = left.withColumn("block", F.pmod(F.xxhash64("qid"), F.ceil(F.lit(64) / F.col("slices"))))
    right = classes.join(sizes, "dim").withColumn("slice", F.pmod(F.xxhash64("cid"), "slices"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(64) / F.col("slices")) - 1)))
    by = ("dim", "slice", "block")
    left, right = left.select(*by, "qid", "payload", "wide").groupBy(*by), right.select(*by, "cid", "payload", "wide", "ids").groupBy(*by)
    return left.cogroup(right).applyInArrow(_wide_scan(keep), "qid bigint, ids array<bigint>, score bigint")


def top_k(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = TOP_K, every: int = QUERY_EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best ``k`` other rows of every row whose key ``every`` divides.

    Exact, ties to the smaller key; a score beyond a long is the nearest long, and ranks as that. Vectors of another length than the
    query's are no candidates. Vectors with components of more than 32 bits are compared apart, each with all, in whole numbers of any size. Rows that share a key
    count once, with the least of their vectors. Equal vectors are one class with its ``k + 1`` smallest keys, which is
    all that can be among the best, so a vector that a third of all rows share is compared once. Other columns are
    ignored; an empty table gives no rows.
    """
    best = k + 1  # the query itself may be among them
    least = F.min(F.struct("dim", "wide", "payload", "low", "high")).alias("v")
    rows = written(integer_vectors(table, key, vector).groupBy("id").agg(least).select("id", "v.*"), "vectors")
    nth = F.row_number().over(Window.partitionBy("dim", "wide", "payload").orderBy("id"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= best)
    every_class = first.groupBy("dim", "wide", "payload").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("cid"))
    every_class = written(every_class, "vector-classes")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "dim", "wide", "payload")
    every_query = written(asked.groupBy("dim", "wide", "payload").agg(F.min("id").alias("qid")), "vector-queries")
    classes, queries = (t.where("not wide").drop("wide") for t in (every_class, every_query))

    # one row per vector length: the grid and into how many slices and blocks the work is cut
    width = F.ceil((F.max("high") - F.min("low") + 1) / CELLS)
    grid = rows.where("not wide").groupBy("dim").agg(F.min("low").alias("grid_low"), width.alias("width"))
    sizes = classes.groupBy("dim").agg(F.ceil(F.count("*") / SLICE_ROWS).alias("slices"))
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks"))
    grid = written(grid.join(sizes, "dim").join(blocks, "dim"), "vector-grid")

    cells = written(_with_cells(classes.join(grid, "dim")), "vector-cells")
    by = ("dim", "slice", "block")
    right = cells.join(grid, "dim").withColumn("slice", F.pmod(F.xxhash64("cid"), "slices"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*by, "cid", "cells")

    def bounds(own: DataFrame, levels: bool) -> DataFrame:
        left = own.join(grid, "dim").withColumn("block", F.pmod(F.xxhash64("qid"), "blocks"))
        left = left.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices", "blocks")
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_scan(best, levels), "qid bigint, cid bigint, lower bigint, upper bigint")
        return written(found, "vector-bounds")

    # a first scan finds the level over all slices that a result must reach, a second one what may reach it
    kth_lower = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("lower").desc(), "cid"))
    level = bounds(queries, True).withColumn("nth", kth_lower).where(F.col("nth") <= best).groupBy("qid").agg(F.min("lower").alias("level"))
    by_bound = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("upper").desc(), "cid"))
    possible = bounds(queries.join(level, "qid"), False).withColumn("nth", by_bound)
    possible = written(possible.select("qid", "cid", "upper", "nth"), "vector-possible")

    def scored(pairs: DataFrame) -> DataFrame:
        of_query = queries.select("qid", F.col("payload").alias("query"))
        return _exact(pairs.join(classes.select("cid", "payload", "ids"), "cid").join(of_query, "qid"))

    early = written(scored(possible.where(F.col("nth") <= FIRST_READS)), "vector-early")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc()))
    certain = early.withColumn("nth", nth).where(F.col("nth") <= best).groupBy("qid").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    late = possible.where(F.col("nth") > FIRST_READS).join(certain, "qid").where((F.col("n") < best) | (F.col("upper") >= F.col("kth")))
    found = early.unionByName(scored(late.select("qid", "cid")))
    if not rows.where("wide").isEmpty():
        found = found.unionByName(_wide_scores(every_query, every_class, best))
    found = found.select("qid", F.explode("ids").alias("vec_id"), "score")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    found = written(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= best), "vector-best")

    named = asked.join(every_query, ["dim", "wide", "payload"]).select(F.col("id").alias("query_id"), "qid")
    pairs = named.join(found, "qid").where("vec_id <> query_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
