"""Semantic chunking: pieces of bounded size that end where the text does, if it can be helped."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

SIZE, OVERLAP = 3500, 400
LONG_DOCUMENT = 2000
#: Where a piece may end, the best first: after blank lines, lines, sentences, words.
_BORDERS = tuple(map(re.compile, (r"\n[ \t]*\n\s*", r"\n\s*", r"[.!?]['\")\]]*\s+", r"\s+")))


def pieces(text: str, size: int = SIZE, overlap: int = 0) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most `size` characters, without white space at their ends.

    A piece ends at the last border of the best kind that leaves it at least half full, else at the
    last of any kind, else after `size` characters. With overlap the next piece begins that many characters
    earlier, at the next word if there is one in that stretch. Together they hold all but white space.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and less than size")
    out, at, n = [], 0, len(text)
    while at < n:
        while at < n and text[at].isspace():
            at += 1
        if at >= n:
            break
        end = n
        if n - at > size:
            end = 0
            for floor in (at + size // 2, at + 1):
                for border in _BORDERS:
                    # A border may reach past the limit with white space that is cut off anyway.
                    ends = [m.start() + len(m.group().rstrip()) for m in border.finditer(text, floor, min(n, at + size + 1))]
                    end = max((e for e in ends if floor <= e <= at + size), default=0)
                    if end:
                        break
                if end:
                    break
            end = end or at + size
        stop = end
        while stop > at and text[stop - 1].isspace():
            stop -= 1
        out.append((at, stop))
        if end >= n:
            break
        if overlap:
            back = max(at + 1, end - overlap)
            word = re.compile(r"\s+(?=\S)").search(text, back, end)
            end = word.end() if word and word.end() < end else back if not word else end
        at = end
    return out


def chunk_spans(text: str, size: int = SIZE, overlap: int = 0, threshold: int = LONG_DOCUMENT) -> list[tuple[int, int]]:
    """pieces() of a text, or all of it if its estimated tokens are fewer than threshold."""
    return pieces(text, max(len(text), 1)) if len(text.encode("utf-8", "surrogatepass")) // 4 < threshold else pieces(text, size, overlap)


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = 0, threshold: int = LONG_DOCUMENT) -> DataFrame:
    """(doc_id, chunk_id, text, start_char, end_char, start_byte, end_byte) [DOM1, FLT6, FLT7, WIN1].

    Texts of fewer than `threshold` estimated tokens are one chunk; null and blank ones have none. Offsets are true
    ones, into the document. No shuffle.
    """

    @F.pandas_udf("array<struct<text:string,start_char:long,end_char:long,start_byte:long,end_byte:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for s in T.slices(batch):
                yield pd.Series([None if t is None else rows(t) for t in s], dtype=object)

    def rows(t: str) -> list[tuple]:
        out, seen, at = [], 0, 0
        for lo, hi in chunk_spans(t, size, overlap, threshold):
            # Pieces may overlap, so bytes are counted on from the last start.
            seen += len(t[at:lo].encode("utf-8", "surrogatepass"))
            at = lo
            own = t[lo:hi]
            out.append((own, lo, hi, seen, seen + len(own.encode("utf-8", "surrogatepass"))))
        return out

    return docs.select("doc_id", F.posexplode(run("text")).alias("chunk_id", "c")).select("doc_id", "chunk_id", "c.*")


def running_offsets(chunks: DataFrame, overlap: int = 0) -> DataFrame:
    """(.., start_byte, end_byte): offsets of (doc_id, chunk_id, n_bytes) laid one after another, each `overlap` back [WIN2]."""
    before = W.partitionBy("doc_id").orderBy("chunk_id").rowsBetween(W.unboundedPreceding, -1)
    start = F.greatest(F.lit(0), F.coalesce(F.sum(F.col("n_bytes") - overlap).over(before), F.lit(0)))
    return chunks.withColumn("start_byte", start.cast("long")).withColumn("end_byte", (F.col("start_byte") + F.col("n_bytes")).cast("long"))


def path_choice(docs: DataFrame, threshold: int = LONG_DOCUMENT) -> DataFrame:
    """(doc_id, tokens, path): short or long, by estimated tokens; null texts have no path [FLT7]."""
    tokens = T.token_estimate(F.col("text"))
    return docs.select("doc_id", tokens.alias("tokens"), F.when(tokens < threshold, "short").when(tokens >= threshold, "long").alias("path"))
