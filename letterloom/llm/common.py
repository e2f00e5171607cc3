"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SPAN = "kind string, start int, end int, value string, score double"
SPAN_ARROW = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64())]
    )
)

Span = tuple[str, int, int, str, float | None]


class SpanSet:
    """Spans of one text; tells whether another one meets any of them."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [s for s, _ in ordered]
        self.furthest = list(accumulate((e for _, e in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.furthest[before - 1] > start


# Bytes of rows that a Python worker gets at once.
BATCH_BYTES = "16m"


def map_batches(
    rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, most: str = BATCH_BYTES
) -> DataFrame:
    """``rows.mapInArrow`` with batches of at most ``most`` bytes, whatever the texts' lengths: texts in a worker take
    several times their bytes, and a session's batches are four times as large by default. The setting stays, as the
    rows are read only when the result is."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    return rows.mapInArrow(run, schema)


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The texts one after another, not all at once."""
    return (t.as_py() for t in column)


def find_spans(docs: DataFrame, key: str, text: str, finder: Callable[[str], list[Span]]) -> DataFrame:
    """``(key, spans)`` with the spans that ``finder`` finds in each whole text (null: as if empty).

    One row per row of ``docs``, in no shuffle; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType([StructField("key", rows.schema["key"].dataType), *StructType.fromDDL(f"spans array<struct<{SPAN}>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in SPAN_ARROW.value_type]
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in finder(t or "")] for t in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPAN_ARROW)], ["key", "spans"])

    return map_batches(rows, run, schema).withColumnRenamed("key", key)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(of_kinds(spans, kind)).cast("long")
