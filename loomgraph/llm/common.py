"""Shared plumbing: input projection, shared-folder checkpoints, Arrow chunking."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import cut, shared_dir

#: Characters of text that one numpy step handles; a longer document is one step of its own.
CHUNK_CHARS = 500_000


def text_frame(docs: DataFrame) -> DataFrame:
    """Only (doc_id LONG, text STRING): other columns, whatever their names, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fresh_name(docs: DataFrame, stem: str) -> str:
    """A column name that docs doesn't have, whatever the case of its letters."""
    taken, name = {c.lower() for c in docs.columns}, f"__{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, whichever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_CHARS) -> Iterator[tuple[list, list]]:
    """(ids, texts) lists of at most `limit` characters, or one document, each; every row is in one of them."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py()
            n = len(t) if t else 0
            if ids and (size + n > limit or len(ids) >= 4000):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += n
    if ids:
        yield ids, texts


def quoted(name: str) -> Column:
    """The column of this name, which may hold dots and backquotes."""
    return F.col("`" + name.replace("`", "``") + "`")


_written = itertools.count()


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, in folders by the column `by` if that is given; it goes when Spark ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{next(_written)}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tree_sum(vectors: DataFrame, fan_in: int = 16, dtype: type = np.float64, read: Callable[[bytes], np.ndarray] | None = None) -> np.ndarray | None:
    """The sum of (m BINARY) rows of numbers, of which each partition has at most one; None if there are none. read: makes the numbers of a row.

    Levels of at most `fan_in` rows a group are added up until one remains, so no task holds more of them and the
    driver one, whatever the number of partitions.
    """
    plain = lambda m: np.frombuffer(m, dtype)

    def adding(of: Callable[[bytes], np.ndarray]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        return lambda key, pdf: pd.DataFrame({"g": [key[0]], "m": [sum(of(m) for m in pdf.sort_values("from")["m"]).tobytes()]})

    of = read or plain
    left = vectors.rdd.getNumPartitions()
    level = vectors.withColumn("g", F.spark_partition_id())
    while left > 1:
        level = level.withColumn("from", F.col("g")).withColumn("g", F.expr(f"int(g DIV {fan_in})")).groupBy("g").applyInPandas(adding(of), "g int, m binary")
        left, of = -(-left // fan_in), plain
    rows = sorted((r["g"], bytes(r["m"])) for r in level.select("g", "m").collect())
    return sum(of(m) for _, m in rows) if rows else None
