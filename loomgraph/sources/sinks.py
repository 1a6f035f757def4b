"""JSON-LD files out, and what a query keeps for itself."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is configured, a temporary one in local mode (tests), else an error:
    executors on other machines wouldn't see it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that what follows neither recomputes it nor loses it with an executor.

    With spark.cleaner.referenceTracking.cleanCheckpoints, Spark deletes the files once nothing refers to the result any more.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_jsonld(docs: DataFrame, path: str, column: str = "jsonld", mode: str = "errorifexists") -> None:
    """[SNK3] a line for each document that isn't null; write_documents() keeps the ids too."""
    docs.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """[SNK3] (doc_id, jsonld ..) as Parquet."""
    docs.write.mode(mode).parquet(path)


def read_jsonld(spark: SparkSession, path: str) -> DataFrame:
    """(path, jsonld) of files with a document a line [SRC3]."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("jsonld"))
