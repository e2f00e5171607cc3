"""Byte expressions: readable sizes and hashes of the first bytes of a content column."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def format_bytes(size: Column, si: bool = False) -> Column:
    """``1280`` as ``1.3 KiB`` (or ``1.3 kB`` with ``si``). Below one unit: ``n B``."""
    base = 1000 if si else 1024
    out = F.when(size < base, F.concat(size.cast("string"), F.lit(" B")))
    for power, letter in enumerate("kMGTPE" if si else "KMGTPE", start=1):
        text = F.format_string(f"%.1f {letter}{'' if si else 'i'}B", size / F.lit(float(base**power)))
        last = power == 6
        out = out.otherwise(text) if last else out.when(size < base ** (power + 1), text)
    return out


@F.pandas_udf(LongType())
def _adler32(content: pd.Series) -> pd.Series:
    return content.map(zlib.adler32, na_action="ignore").astype("Int64")


def prefix_hash(content: Column, algorithm: str = "adler32", prefix_bytes: int | None = None) -> Column:
    """Hash of a binary column, whole unless only its first ``prefix_bytes`` bytes are asked for."""
    head = content if prefix_bytes is None else F.substring(content, 1, prefix_bytes)
    known = {"crc32": F.crc32, "adler32": _adler32, "fast64": F.xxhash64, "md5": F.md5}
    if algorithm not in known:
        raise ValueError(f"hash must be one of {sorted(known)}")
    return known[algorithm](head)
