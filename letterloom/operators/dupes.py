"""Groups of rows whose content has the same hash.

A hash of 32 or 64 bits, or one of a prefix, is only where to look: rows form a group if their whole
contents have the same length and digest too, unless ``verify=False`` asks for the hash alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.functions.bytes import prefix_hash
from letterloom.operators.skew import HOT_ROWS, for_each_shard, hot_keys, with_shard
from letterloom.session import written

PREFIX_BYTES = 1 << 20


def hashed(
    df: DataFrame,
    key: str,
    content: str = "content",
    algorithm: str = "adler32",
    prefix_bytes: int | None = None,
    verify: bool | None = None,
) -> DataFrame:
    """``(key, hash)`` of each non-empty content, plus size and whole digest if verified."""
    body = F.col(content).cast("binary")
    code = prefix_hash(body, algorithm, prefix_bytes)
    # never null here; said so, a join on the hash adds no filter that would hash everything again
    code = F.coalesce(code, F.lit("" if algorithm == "md5" else 0))
    columns = [F.col(key), code.alias("hash")]
    if _verified(algorithm, prefix_bytes, verify):
        columns += [F.length(body).alias("bytes"), F.coalesce(F.sha2(body, 256), F.lit("")).alias("digest")]
    return df.where(F.length(body) > 0).select(*columns)


def _verified(algorithm: str = "adler32", prefix_bytes: int | None = None, verify: bool | None = None, **_) -> bool:
    return (algorithm != "md5" or prefix_bytes is not None) if verify is None else verify


def _group_columns(options: dict) -> list[str]:
    return ["hash", "bytes", "digest"] if _verified(**options) else ["hash"]


def _groups(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


def dup_groups(df: DataFrame, key: str, **options) -> DataFrame:
    """One row per group of two or more: hash, ``n`` members and the smallest key."""
    by = _group_columns(options)
    return _groups(hashed(df, key, **options), key, by)


def dup_members(df: DataFrame, key: str, hot_rows: int = HOT_ROWS, **options) -> DataFrame:
    """One row per member of a group: hash, key, ``n``, ``first_key``.

    The long form holds groups of any size: a group is never gathered into one row, and the
    rows of a hot hash are joined to their group over as many shards as their share needs. The
    repartition makes one exchange of narrow rows that all later uses share, so the contents
    themselves are read and hashed once.
    """
    by = _group_columns(options)
    rows = hashed(df, key, **options).repartition(key)
    groups = _groups(rows, key, by)
    hot = hot_keys(groups, by, "n", least_rows=hot_rows)
    members = with_shard(rows, hot, by, F.col(key))
    return members.join(for_each_shard(groups, hot, by), [*by, "shard"]).select(*by, key, "n", "first_key")


def staged_members(
    listing: DataFrame, contents_of: Callable[[DataFrame], DataFrame], key: str, prefix_bytes: int = PREFIX_BYTES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Members of groups with equal contents, looked for where it costs least first.

    ``listing`` has key and size; rows of a size that no other has are done with, and so are sizes of 0 or null.
    ``contents_of(rows)`` gives ``(key, content)`` of the keys asked for: first the survivors' prefixes are hashed, then the whole contents
    of those that share size and prefix.
    """
    sized = listing.where("size > 0").select(key, "size")
    same_size = sized.groupBy("size").count().where("count > 1").select("size")
    left = written(sized.join(same_size, "size"), "same-size")
    code = prefix_hash(F.col("content").cast("binary"), "md5", prefix_bytes).alias("code")
    coded = left.join(contents_of(left.select(key)).select(key, code), key)
    coded = written(coded, "same-prefix")
    shared = coded.groupBy("size", "code").count().where("count > 1").select("size", "code")
    left = written(coded.join(shared, ["size", "code"]).select(key), "same-prefix")
    return dup_members(contents_of(left), key, hot_rows, content="content", algorithm="md5")
