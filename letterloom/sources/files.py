"""File listings as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from letterloom.session import empty

# Small files are read by so many tasks a core at most. Spark's own packing gives a task a few of them, whatever they hold.
TASKS_PER_CORE = 8
# Files that a task writes into one folder: Spark lists folders at the same time, the files of one after each other.
FILES_PER_FOLDER = 250


def _glob(suffix: str, ignore_case: bool) -> str:
    def one(ch: str) -> str:
        if ignore_case and ch.lower() != ch.upper():
            return f"[{ch.lower()}{ch.upper()}]"
        return f"\\{ch}" if ch in "*?[]{}\\" else ch

    return "*" + "".join(one(ch) for ch in suffix)


def scan_files(
    spark: SparkSession,
    roots: str | list[str],
    suffix: str = "",
    ignore_case: bool = True,
    modified_since=None,
) -> DataFrame:
    """Files below ``roots`` whose name ends in ``suffix``: path, modificationTime, length, content.

    Directories are entered whatever their name. A root that does not exist is skipped, and so is
    one that lies inside another, whose listing holds its files already. Empty files are not
    listed. Contents are read only where ``content`` is selected; ``modified_since`` is pushed
    into the scan. Many files are a few tasks' work: ``TASKS_PER_CORE``.
    """
    present = [root for root in outermost([roots] if isinstance(roots, str) else roots) if _exists(spark, root)]
    if not present:
        return empty(spark, "path string, modificationTime timestamp, length bigint, content binary")
    files = _binary_files(spark, suffix, ignore_case).load(present)
    files = files if modified_since is None else files.where(F.col("modificationTime") >= F.lit(modified_since))
    return files.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def _exists(spark: SparkSession, root: str) -> bool:
    """Whether the root's file system knows it; its listing is left to the scan."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def outermost(roots: list[str]) -> list[str]:
    """The given roots without repeats and without those below another one."""
    tidy = sorted({root.rstrip("/") for root in roots}, key=len)
    out: list[str] = []
    for root in tidy:
        if not any(root == other or root.startswith(other + "/") for other in out):
            out.append(root)
    return out


def _binary_files(spark: SparkSession, suffix: str, ignore_case: bool) -> DataFrameReader:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _glob(suffix, ignore_case))
    )


def write_files(rows: DataFrame, root: str, folder: str, name: str) -> None:
    """The ``value`` of each row as a line of a text file of its own below ``root``, in folders by one column and named by another.
    Rows of a task that agree in both share a file.

    In a local file system, or one that is mounted like one, tasks write the files: Hadoop starts two processes for each file there, to set
    its permissions, and a directory for each file makes a listing as many tasks. Elsewhere Spark's writer does it.
    """
    spark, keys = rows.sparkSession, [folder, name]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = urlsplit(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString())
    if uri.scheme != "file":
        # tasks move their own files into place; otherwise the driver moves them all, one after another
        moved = rows.select(*keys, "value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        moved.partitionBy(*keys).text(root)
        return
    sorted_rows = rows.select(*[_part_of_path(c) for c in keys], F.col("value").cast("binary").alias("value")).sortWithinPartitions(*keys)
    files = sorted_rows.mapInArrow(_lines_to_files(unquote(uri.path)), "files bigint")
    files.agg(F.sum("files")).first()


def _part_of_path(column: str) -> Column:
    """``column=value``, with the name that Spark's writer gives to no value."""
    text = F.col(column).cast("string")
    value = F.when(F.length(text) > 0, F.url_encode(text)).otherwise(F.lit("__HIVE_DEFAULT_PARTITION__"))
    return F.concat(F.lit(f"{column}="), value).alias(column)


def _lines_to_files(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted ``folder, name, value`` rows to files, each put in its place when it is whole, so a task that runs again only repeats them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, passing = f"part-{task.partitionId():05d}", f".passing-{task.taskAttemptId()}"
        done, here, key, file, made = 0, 0, None, None, ""
        for batch in batches:
            for folder, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (folder, name) != key:
                    if file:
                        file.close()
                        os.replace(f"{made}/{passing}", f"{made}/{key[1]}.txt")
                    here = here + 1 if key and key[0] == folder else 0
                    key, done = (folder, name), done + 1
                    made = f"{root}/{folder}/{part}-{here // FILES_PER_FOLDER:04d}"
                    if here % FILES_PER_FOLDER == 0:
                        os.makedirs(made, exist_ok=True)
                    file = open(f"{made}/{passing}", "wb")  # noqa: SIM115
                file.write((value or b"") + b"\n")
        if file:
            file.close()
            os.replace(f"{made}/{passing}", f"{made}/{key[1]}.txt")
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["files"])

    return write


def listing(files: DataFrame) -> DataFrame:
    """``path, id, stamp, size``: what a refresh needs, without contents. ``stamp`` is in ms."""
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("id"),
        F.unix_millis("modificationTime").alias("stamp"),
        F.col("length").alias("size"),
    )


def oldest_first(files: DataFrame) -> DataFrame:
    """A scan in the order of modification, for a listing that is shown."""
    return files.orderBy("modificationTime", "path")
