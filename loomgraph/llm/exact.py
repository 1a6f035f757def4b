"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each source partition sorts the fingerprints of its texts and sends every owner
   (a range of fingerprints) one compressed block of differences.
2. The owner decodes its blocks, finds the fingerprints that occur more than once
   and answers each source with a bitmap over the block it sent.
3. Sources turn the bits that are set into suspects. Only rows with a suspect
   fingerprint are shuffled with their text, and texts are compared byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_name, quoted, text_frame

#: Bits of a fingerprint. Unequal texts that share one are told apart in step 3.
BITS = 52
#: Suspect fingerprints up to this many bytes are broadcast to the scan; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def rice_parameter(n: int, universe: int) -> int:
    """Bits of the remainder that suit n values spread over the universe."""
    return max(0, int(math.log2(max(1.0, math.log(2) * universe / max(1, n)))))


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted non-negative integers as quotients in unary and k-bit remainders of their differences."""
    n = len(values)
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    rest = np.empty((n, k), np.uint8)
    for bit in range(k):
        rest[:, bit] = (gaps >> (k - 1 - bit)) & 1
    head = np.array([n, len(unary)], "<u8").tobytes() + bytes([k])
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(block: bytes) -> np.ndarray:
    n, bits = np.frombuffer(block, "<u8", 2).tolist()
    k, width = block[16], (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(block, np.uint8, width, 17), count=bits)
    quotients = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(block, np.uint8, offset=17 + width), count=n * k).reshape(n, k)
    value = quotients.astype(np.int64)
    for bit in range(k):
        value = value << 1 | rest[:, bit]
    return np.cumsum(value)


def duplicate_bits(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """For each block, which of its values occur more than once among all blocks."""
    together = np.sort(np.concatenate(blocks)) if blocks else np.empty(0, np.int64)
    twice = np.unique(together[1:][together[1:] == together[:-1]])
    return [np.isin(b, twice) for b in blocks]


def fingerprint(text: str = "text"):
    return F.shiftrightunsigned(F.xxhash64(F.col(text).cast("string")), 64 - BITS)


def suspects(texts: DataFrame) -> DataFrame:
    """(f): fingerprints that more than one row of (doc_id, text) has; null texts have none."""
    spark = texts.sparkSession
    own = texts.filter(F.col("text").isNotNull()).select(fingerprint().alias("f"))
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    span = -(-(1 << BITS) // owners)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [b.column(0).to_numpy() for b in batches]
        if not have:
            return
        f = np.sort(np.concatenate(have))
        edges = np.searchsorted(f, np.arange(1, owners, dtype=np.int64) * span)
        parts = [(o, p - o * span) for o, p in enumerate(np.split(f, edges)) if len(p)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o for o, _ in parts], pa.int32()), pa.array([golomb_encode(p, rice_parameter(len(p), span)) for _, p in parts], pa.binary())],
            ["owner", "block"],
        )

    # The blocks are kept, since the sources read the answer against what they sent.
    sent = cut(own.mapInArrow(send, "owner int, block binary").withColumn("source", F.spark_partition_id()))

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = duplicate_bits([golomb_decode(b) for b in pdf["block"]])
        return pd.DataFrame({"source": pdf["source"], "owner": pdf["owner"], "bitmap": [np.packbits(b).tobytes() if b.any() else None for b in bits]})

    answers = sent.groupBy("owner").applyInPandas(answer, "source int, owner int, bitmap binary").filter("bitmap IS NOT NULL")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o, block, bitmap in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                f = golomb_decode(block)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(f[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(f)).astype(bool)]) + o * span)], ["f"])

    return sent.join(answers, ["source", "owner"]).select("owner", "block", "bitmap").mapInArrow(read, "f long").distinct()


def with_suspicion(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with two more columns, whose names are returned: the fingerprint, and true where it is suspect, else null."""
    f, flag = fresh_name(docs, "fingerprint"), fresh_name(docs, "suspect")
    found = cut(suspects(text_frame(docs)))
    found = found.select(F.col("f").alias(f), F.lit(True).alias(flag))
    if found.count() * 16 <= BROADCAST_BYTES:
        found = F.broadcast(found)
    return docs.withColumn(f, fingerprint(text)).join(found, f, "left"), f, flag


def _groups(suspect: DataFrame, f: str) -> tuple[DataFrame, DataFrame]:
    """(f, kept, n) of the fingerprints whose texts are all the same, and (f, text, kept, n) of the texts that share one with another text.

    Bytes are compared by the least and the greatest text of a fingerprint, which are combined before the shuffle, so a text
    with however many copies is sent once a partition and no task holds a list of them. kept is the least id (null if all are).
    """
    kept, n = F.min("doc_id").alias("kept"), F.count("*").alias("n")
    by = cut(suspect.groupBy(f).agg(F.min("text").alias("low"), F.max("text").alias("high"), kept, n).select(f, "kept", "n", (F.col("low") == F.col("high")).alias("one")))
    odd = suspect.join(_small(by.filter("NOT one").select(f)), f)
    return by.filter("one").select(f, "kept", "n"), odd.groupBy(f, "text").agg(kept, n)


def _small(keys: DataFrame) -> DataFrame:
    """keys, for broadcast if counting them shows that they are few; else adaptive execution parts what is hot in the join."""
    return F.broadcast(keys) if keys.count() * 32 <= BROADCAST_BYTES else keys


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_id): every row whose text another row holds too, but for the row kept, and the kept row's id.

    The row with the smallest doc_id is kept (null ids come after all others). Texts are compared byte by
    byte, without normalisation. Null texts are no copies of each other; empty ones are. Of repeated rows
    (same id and text) all but one are listed, with kept_id equal to doc_id where the id itself is kept. Very long
    texts are compared whole; other columns are ignored.
    """
    flagged, f, flag = with_suspicion(text_frame(docs))
    suspect = flagged.filter(F.col(flag)).select("doc_id", "text", f)
    same, odd = _groups(suspect, f)
    of_same = suspect.select("doc_id", f).join(_small(same.filter("n > 1")), f).select("doc_id", "kept", f, F.lit(None).cast("string").alias("text"))
    of_odd = suspect.join(odd.filter("n > 1"), [f, "text"]).select("doc_id", "kept", f, "text")
    rows = of_same.unionAll(of_odd)
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept"))
    again = rows.filter(is_kept).groupBy(f, "text").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("n > 1")
    again = again.select(F.col("kept").alias("doc_id"), "kept", F.explode(F.sequence(F.lit(2), "n"))).select("doc_id", "kept")
    return rows.filter(~is_kept).select("doc_id", "kept").unionAll(again).withColumnRenamed("kept", "kept_id")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, without the rows that repeat another row's text.

    Which row stays: see exact_duplicates(); of rows with the same id and text the one that is first as JSON.
    Rows with a null text stay, one of the empty ones does.
    """
    flagged, f, flag = with_suspicion(docs)
    names = docs.columns
    row, kept = fresh_name(docs, "row"), fresh_name(docs, "kept")
    same, odd = _groups(flagged.filter(F.col(flag)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), f), f)
    every = F.struct(*map(quoted, names))
    suspect = flagged.filter(F.col(flag)).select(f, every.alias(row), F.to_json(every).alias(kept), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = lambda rows: rows.filter(F.col("doc_id").eqNullSafe(F.col("kept"))).select(f, "text", row, F.col(kept).alias("order"))
    stays = own(suspect.join(_small(same), f)).unionAll(own(suspect.join(odd, [f, "text"])))
    first = stays.groupBy(f, "text").agg(F.min_by(row, "order").alias(row)).select(f"{row}.*")
    return flagged.filter(F.col(flag).isNull()).select(*map(quoted, names)).unionAll(first)


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_duplicates() of all documents; those with a null text or a text of their own have no row."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
SELECT doc_id, kept_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n
  FROM documents WHERE text IS NOT NULL)
WHERE n > 1
"""
