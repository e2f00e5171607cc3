"""Session settings and the shared folder that written tables go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def build_session(master: str | None = None, app: str = "letterloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and any extra settings (dots as ``__``)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session, where driver and executors are one process, falls back to a
    temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="letterloom-"))
    return sc.getCheckpointDir().rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps what it writes in between."""
    return f"{shared_folder(spark)}/letterloom/{spark.sparkContext.applicationId}"


_INSIDE: ContextVar[str] = ContextVar("inside", default="")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the application's folder that nothing else uses."""
    return f"{own_folder(spark)}/{_INSIDE.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """What is written in between inside this block is deleted at its end; frames that read it end with it."""
    outer, inside = _INSIDE.get(), f"passing-{uuid.uuid4().hex}"
    _INSIDE.set(f"{outer}{inside}/")
    try:
        yield
    finally:
        _INSIDE.set(outer)
        drop_folder(spark, f"{own_folder(spark)}/{outer}{inside}")


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> None:
    """Delete all that this application has written in between; frames that still read it end with it."""
    drop_folder(spark, own_folder(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors, and of a
    size that Spark knows before it plans the next join (so it broadcasts it only if it is small)."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of the given schema."""
    fields = StructType.fromDDL(schema).fields
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
