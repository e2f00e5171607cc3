"""Messages from file contents, and the texts, headers and documents an index takes from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from letterloom.functions import mime
from letterloom.functions.text import body_text

# the decoding of values travels with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(mime)

MESSAGE_SCHEMA = (
    "path string, id string, stamp bigint, size bigint, "
    "headers array<struct<name:string,value:string>>, multipart boolean, "
    "parts array<struct<idx:int,content_type:string,text:string>>, "
    "subject string, `from` array<string>, sent timestamp, error string"
)
# The field searched by default: all text parts of a message in order.
DEFAULT_FIELD = "body_all"
# Bytes of values that a Python worker decodes at once; as lists of strings they take several times as much.
DECODED_TOGETHER = 1 << 20


def ingest_messages(files: DataFrame, depth: int | None = None) -> DataFrame:
    """Cut ``path, modificationTime, length, content`` rows into messages.

    A file without headers becomes a row with ``error`` set; it never fails the job. Cutting is a projection; the values that
    need decoding pass Python a batch at a time, whose bytes Spark bounds (``spark.sql.execution.arrow.maxBytesPerBatch``), and
    are decoded ``DECODED_TOGETHER`` bytes at a time there.
    """
    listed = files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("id"),
        F.unix_millis("modificationTime").alias("stamp"),
        F.col("length").alias("size"),
        mime.entity(mime.signs(F.col("content"))).alias("root"),
    )
    cut = listed.select("path", "id", "stamp", "size", F.col("root.headers"), F.col("root.multi").alias("multipart"), F.array("root").alias("parts"))
    opened = mime.opened(F.col("parts"))
    for _ in range(mime.MOST_NESTED if depth is None else depth):
        cut = cut.withColumn("parts", opened)  # a projection each: nested in one, they would be too deep
    cut = cut.withColumn("parts", F.transform("parts", _undecoded))
    rows = cut.mapInArrow(_decoded, StructType([f for f in cut.schema.fields if f.name != "parts"] + StructType.fromDDL(_PARTS).fields))
    good = F.size("headers") > 0
    sender = F.flatten(F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == "from"), lambda h: mime.senders(h["value"])))
    return rows.select(
        "path", "id", "stamp", "size",
        *[F.when(good, F.col(c)).alias(c) for c in ("headers", "multipart", "parts")],
        mime.header(F.col("headers"), "subject").alias("subject"),
        F.when(good, sender).alias("from"),
        mime.sent_at(mime.header(F.col("headers"), "date")).alias("sent"),
        F.when(~good, F.lit("no headers")).alias("error"),
    )


_PARTS = "parts array<struct<idx:int,content_type:string,text:string>>"


def _undecoded(part, idx):
    """A part before it is decoded: what it says of itself, and its body if that is text."""
    text = F.rlike(F.lower(part["kind"]), F.lit("^text/(plain|html)")) & ~part["multi"]
    return F.struct(
        idx.alias("idx"),
        part["kind"].alias("content_type"),
        F.coalesce(mime.header(part["headers"], "content-transfer-encoding"), F.lit("")).alias("encoding"),
        mime.parameter(part["kind"], "charset").alias("charset"),
        F.when(text, part["body"]).alias("raw"),
    )


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header values and parts' texts decoded, in their lists."""
    for batch in (some for b in batches for some in _runs(b)):
        headers, parts = batch.column("headers"), batch.column("parts")
        flat = headers.flatten()
        values = pa.array([mime.decoded_words(v) for v in flat.field("value").to_pylist()], pa.string())
        fields = parts.flatten()
        raw = zip(*(fields.field(c).to_pylist() for c in ("raw", "encoding", "charset")), strict=True)
        texts = pa.array(["" if r is None else mime.decoded_part(r, e, c) for r, e, c in raw], pa.string())
        named = pa.StructArray.from_arrays([flat.field("name"), values], ["name", "value"])
        whole = pa.StructArray.from_arrays([fields.field("idx"), fields.field("content_type"), texts], ["idx", "content_type", "text"])
        lists = [pa.ListArray.from_arrays(_offsets(own), new) for own, new in ((headers, named), (parts, whole))]
        rest = [batch.column(c) for c in ("path", "id", "stamp", "size")]
        yield pa.RecordBatch.from_arrays([*rest, lists[0], batch.column("multipart"), lists[1]], ["path", "id", "stamp", "size", "headers", "multipart", "parts"])


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs that hold ``DECODED_TOGETHER`` bytes to decode at most, or one message that holds more."""
    ends = np.cumsum(_bytes(batch.column("headers"), "value") + _bytes(batch.column("parts"), "raw"))
    at = 0
    while at < batch.num_rows:
        most = (ends[at - 1] if at else 0) + DECODED_TOGETHER
        end = max(at + 1, int(np.searchsorted(ends, most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _bytes(lists: pa.ListArray, field: str) -> np.ndarray:
    """The bytes of a field in each list."""
    each = pc.fill_null(pc.binary_length(lists.flatten().field(field)), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
    return np.diff(before[_offsets(lists).to_numpy()])


def _offsets(lists: pa.ListArray) -> pa.Array:
    sizes = lists.value_lengths().to_pylist()
    out = [0]
    for n in sizes:
        out.append(out[-1] + (n or 0))
    return pa.array(out, pa.int32())


def rejects(messages: DataFrame) -> DataFrame:
    """Files that could not be parsed, with the reason."""
    return messages.where("error is not null").select("path", "id", "stamp", "size", "error")


def header_lines(messages: DataFrame) -> DataFrame:
    """``path, idx, line``: each header as ``name: value``, in the order of the message."""
    exploded = messages.select("path", F.posexplode("headers").alias("idx", "h"))
    return exploded.select("path", "idx", F.concat("h.name", F.lit(": "), "h.value").alias("line"))


def message_docs(messages: DataFrame) -> DataFrame:
    """``doc_id, path, id, stamp``; the full path is the key, so equal file names do not collide."""
    good = messages.where("error is null")
    return good.select(F.col("path").alias("doc_id"), "path", "id", "stamp")


def message_texts(messages: DataFrame, per_part: bool = True) -> DataFrame:
    """``doc_id, field, values``: one row per header name, per body part, and for all parts together.

    A single body is the field ``body``; parts of a multi-part message are ``body-0``, ``body-1``
    and so on. ``per_part=False`` leaves the part fields out.
    """
    text = F.transform("parts", lambda p: body_text(p["content_type"], p["text"]))
    good = messages.where("error is null").select(F.col("path").alias("doc_id"), "headers", "multipart", text.alias("t"))
    names = F.array_distinct(F.transform("headers", lambda h: h["name"]))
    header_fields = F.transform(
        names,
        lambda n: F.struct(
            n.alias("field"),
            F.transform(F.filter("headers", lambda h: h["name"] == n), lambda h: h["value"]).alias("values"),
        ),
    )
    part_fields = F.transform(
        "t",
        lambda v, i: F.struct(
            F.when(F.col("multipart"), F.concat(F.lit("body-"), i)).otherwise(F.lit("body")).alias("field"),
            F.array(v).alias("values"),
        ),
    )
    all_parts = F.array(F.struct(F.lit(DEFAULT_FIELD).alias("field"), F.filter("t", lambda v: v != "").alias("values")))
    fields = F.concat(header_fields, all_parts, part_fields) if per_part else F.concat(header_fields, all_parts)
    exploded = good.select("doc_id", F.explode(fields).alias("f"))
    return exploded.select("doc_id", "f.field", "f.values").where(F.size("values") > 0)
