"""The queries of this subpackage's operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from letterloom.llm.alignment import alignment_report
from letterloom.llm.chat import chat_report
from letterloom.llm.decontaminate import contamination
from letterloom.llm.html_text import pages_report
from letterloom.llm.language import language_report
from letterloom.llm.mixture import mixture_report
from letterloom.llm.phrases import top_phrases
from letterloom.llm.pii import pii_report
from letterloom.llm.secrets import secrets_report
from letterloom.llm.simhash import near_duplicates
from letterloom.llm.tokens import encode_documents
from letterloom.llm.toxicity import toxicity_report
from letterloom.llm.vectors import top_k


def _over(table: str, run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(documents, benchmark)


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity_report(documents, labels)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": _over("documents", secrets_report),
    "op2_main_text": _over("pages", pages_report),
    "op3_chat": _over("conversations", chat_report),
    "op4_language": _over("documents", language_report),
    "op5_contamination": _contamination,
    "op6_token_shards": _over("documents", encode_documents),
    "op7_simhash": _over("documents", near_duplicates),
    "op8_pii": _over("documents", pii_report),
    "op9_top_k": _over("embeddings", top_k),
    "op10_mixture": _over("documents", mixture_report),
    "op11_phrases": _over("documents", top_phrases),
    "op12_alignment": _over("documents", alignment_report),
    "op13_toxicity": _toxicity,
}
