"""From raw documents to training windows: repetition rules, exact and near deduplication, secrets, packing.

Every stage is a function of (spark, docs, sf_dir). It works on all rows that the stage before it kept, and
its decisions take effect; all but the last return the columns of documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import exact, packing, quality, secrets, simhash
from loomgraph.llm.common import remove, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose repetition is within the limits. Null texts go, empty ones stay; each repeated row is judged by itself."""
    return quality.repetition_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set with the same text: the one with the smallest doc_id. Null texts stay, and one of the empty ones."""
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Null and empty texts and rows without an id stay."""
    return simhash.near_dedup(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret. Null and empty texts stay as they are; each repeated row is cleaned."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in each training window. Null and empty texts and rows without an id are in none; an id counts once."""
    return packing.pack_related(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

_runs = itertools.count()

#: Neither suffix-array repetition nor the packing of neighbours can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written as Parquet to the shared folder and read again by the next.

    A stage's files are deleted when those of the next are complete; the last one's stay for the caller to read.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{spark.sparkContext.applicationId}-{next(_runs)}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
