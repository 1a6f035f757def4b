"""Quality rules on repetition inside a document, read off its suffix array.

Adjacent suffixes of the sorted array share prefixes; the intervals in which the
shared length stays at or above a minimum are the document's maximal repeated
substrings. The union of their occurrences, as a share of the document, and the
longest of them are each limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, chunks, fresh_name, text_frame
from .kernel import mix, powers, inverse

MIN_REPEAT = 30
MAX_COVERED = 0.6
MAX_LONGEST = 1000
_BASE = 0xD6E8FEB86659FD93


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes in sorted order and the prefix that each shares with the one before it (0 for the first).

    Prefix doubling; the ranks of each round are kept and give the shared lengths by descending powers of two.
    """
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels = [rank.astype(np.int32)]
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.empty(n, np.int64)
        step[0] = 0
        sorted_key = key[order]
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=step[1:])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            break
        levels.append(rank.astype(np.int32))
        k *= 2
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        width, ranks = 1 << level, levels[level]
        # Equal ranks of a round mean equal substrings of its width unless one of them runs into the end.
        fits = np.maximum(a, b) + width <= n
        same = np.zeros(n - 1, bool)
        same[fits] = ranks[a[fits]] == ranks[b[fits]]
        lcp[1:][same] += width
        a[same] += width
        b[same] += width
    return order, lcp


def repetition(text: str, min_repeat: int = MIN_REPEAT) -> tuple[int, int]:
    """(characters in occurrences of substrings of at least min_repeat characters that occur again, longest of these)."""
    codes = codes_of(text)
    n = len(codes)
    if n <= min_repeat:
        return 0, 0
    order, lcp = suffix_array(codes)
    inside = lcp >= min_repeat  # position r: suffixes r-1 and r belong to one interval
    reach = np.maximum(np.where(inside, lcp, 0), np.append(np.where(inside, lcp, 0)[1:], 0))
    held = reach > 0
    if not held.any():
        return 0, 0
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, order[held], 1)
    np.add.at(edges, order[held] + reach[held], -1)
    return int((np.cumsum(edges[:-1]) > 0).sum()), int(lcp.max())


def has_repeats(texts: list[str | None], min_repeat: int) -> np.ndarray:
    """Whether some window of min_repeat characters occurs twice in each text.

    The texts without one have no interval, so their arrays needn't be built. Equal windows have equal
    hashes, so none is missed; unequal ones with equal hashes cost only an array built in vain.
    """
    out = np.zeros(len(texts), bool)
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    if begin[-1] < min_repeat:
        return out
    codes = codes_of("".join(t for t in texts if t)).astype(np.uint64) + np.uint64(1)
    codes *= np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(31)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(_BASE, len(codes)), out=sums[1:])
    h = mix((sums[min_repeat:] - sums[:-min_repeat]) * powers(inverse(_BASE), len(codes))[: len(codes) - min_repeat + 1])
    bits = np.uint64(max(1, int(len(texts)).bit_length()))
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    keep = np.ones(len(h), bool)
    for e in begin[1:-1]:  # windows over the border of two texts
        keep[max(0, e - min_repeat + 1) : e] = False
    key = np.sort(((h << bits) | doc[: len(h)])[keep])
    twice = key[1:][key[1:] == key[:-1]]
    out[np.unique(twice & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    return out


def repetition_measures(docs: DataFrame, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """(doc_id, n_chars, covered_chars, covered_fraction, longest_repeat) of every row.

    Null texts have nulls; empty ones, and those no longer than min_repeat, zeros. Characters are code
    points. Repeated rows are measured each; other columns are ignored. Needs no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            rows = [None if t is None else (0, 0) for t in texts]
            for i in np.flatnonzero(has_repeats(texts, min_repeat)):
                rows[i] = repetition(texts[i], min_repeat)
            sizes = [None if t is None else len(t) for t in texts]
            covered = [None if r is None else r[0] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(covered, pa.int64()),
                    pa.array([None if c is None else (c / n if n else 0.0) for c, n in zip(covered, sizes)], pa.float64()),
                    pa.array([None if r is None else r[1] for r in rows], pa.int64()),
                ],
                ["doc_id", "n_chars", "covered_chars", "covered_fraction", "longest_repeat"],
            )

    return text_frame(docs).mapInArrow(run, "doc_id long, n_chars long, covered_chars long, covered_fraction double, longest_repeat long")


def passes(max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST):
    return (F.col("covered_fraction") <= max_covered) & (F.col("longest_repeat") <= max_longest)


def repetition_filter(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of docs, with all their columns, whose repetition is within the limits.

    Rows with a null text are dropped: there is nothing to train on. Empty texts stay, since they repeat
    nothing. Each repeated row is judged by itself. One pass, no shuffle: the verdict is computed beside the row.
    """
    flag = fresh_name(docs, "kept")

    @F.pandas_udf("boolean")
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            texts = [t if isinstance(t, str) else None for t in column]
            rows = [t is not None for t in texts]
            for lo, hi in _slices(texts):
                for i in np.flatnonzero(has_repeats(texts[lo:hi], min_repeat)):
                    t = texts[lo + i]
                    covered, longest = repetition(t, min_repeat)
                    rows[lo + i] = covered / len(t) <= max_covered and longest <= max_longest
            yield pd.Series(rows, dtype=bool)

    verdict = verdict.asNondeterministic()  # so that the optimizer runs it once a row
    return docs.withColumn(flag, verdict(F.col("text").cast("string"))).filter(F.col(flag)).drop(flag)


def _slices(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and (size + n > limit or i - lo >= 4000):
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their measures."""
    return repetition_measures(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter(passes())
