"""From raw documents to token shards: each stage reads what the one before it kept.

run() writes every stage's result to the shared folder and reads it again, so a lost executor costs
at most the stage that is running. What a stage wrote for itself, and what it read, is deleted when its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from letterloom.llm.decontaminate import decontaminated
from letterloom.llm.language import in_language
from letterloom.llm.mixture import mixed
from letterloom.llm.simhash import one_of_each
from letterloom.llm.tokens import encode_documents
from letterloom.session import drop_folder, new_folder, passing_tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; texts that are null or have no letters go."""
    return in_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link: the least key, null last. Texts without words are one group."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, parts and copies of them in the proportions of the sources' targets."""
    return mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token shards hold of each document."""
    return encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_shards", token_shards),
]

# A learned filter, XXH64 and a tokenizer are not SQL; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        with passing_tables(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        if read:
            drop_folder(spark, read)
        docs, read = spark.read.schema(result.schema).parquet(path), path
    return docs
