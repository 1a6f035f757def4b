"""Corpus-wide suffix-array deduplication, built one bucket of suffixes at a time.

A passage is repeated if some run of MIN_WORDS words occurs again. Two occurrences
of such a run choose the same anchor, the run of ANCHOR words within it whose hash
is smallest, so all suffixes that share their first MIN_WORDS words share an anchor.
Only anchors that occur more than once are kept. A reduce task gets the segments of
text around each of its anchors, and sorts the suffixes that begin in them:

* lexicographic ranks of all blocks of V words, by doubling;
* a difference cover modulo V: a set of residues such that for any two positions
  some shift below V takes both into the set. Suffixes at these positions are the
  sample; their complete order is worked out once, by doubling over whole blocks;
* one bucket after another (a range of first-block ranks) is sorted by the first
  block, and suffixes that tie there by the ranks of the sample suffixes a common
  shift ahead. Memory holds one bucket's keys besides the text and the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import chunks, text_frame
from .kernel import Words, mix, run_hash, run_sums, words

MIN_WORDS = 50
ANCHOR = 10
V = 16
#: Suffixes in a bucket, and words of text in a step of a reduce task (one anchor's segments are never parted).
BUCKET = 200_000
STEP_WORDS = 600_000


def difference_cover(v: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences are all residues modulo v."""
    for size in range(1, v + 1):
        for rest in combinations(range(1, v), size - 1):
            cover = (0, *rest)
            if len({(a - b) % v for a in cover for b in cover}) == v:
                return cover
    raise AssertionError


COVER = difference_cover(V)
_IN_COVER = np.isin(np.arange(V), COVER)
#: _SHIFT[a, b]: the shift that takes positions of residues a and b into the cover.
_SHIFT = np.array([[next(s for s in range(V) if (a + s) % V in COVER and (b + s) % V in COVER) for b in range(V)] for a in range(V)])


def dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    step = np.zeros(len(key), np.int64)
    k = key[order]
    np.cumsum(k[1:] != k[:-1], out=step[1:])
    out = np.empty(len(key), np.int64)
    out[order] = step
    return out


def block_ranks(tokens: np.ndarray) -> np.ndarray:
    """The lexicographic rank of the V tokens from each position on; what lies beyond the end sorts first."""
    rank, k, n = dense(tokens) + 1, 1, len(tokens)
    while k < V:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - k)] = rank[k:]
        rank = dense(rank << 32 | ahead) + 1
        k *= 2
    return rank


def sample_ranks(block: np.ndarray) -> np.ndarray:
    """For the positions in the cover, the rank of their suffix among them; elsewhere 0.

    Position p + V is in the cover with p, so ranks double over whole blocks until all differ.
    """
    n = len(block)
    at = np.flatnonzero(_IN_COVER[np.arange(n) % V])
    out = np.zeros(n, np.int64)
    out[at] = dense(block[at]) + 1
    step = V
    while len(at) and out[at].max() < len(at):
        ahead = np.zeros(len(at), np.int64)
        inside = at + step < n
        ahead[inside] = out[at[inside] + step]
        out[at] = dense(out[at] << 32 | ahead) + 1
        step *= 2
    return out


def sort_bucket(starts: np.ndarray, block: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """starts in the order of their suffixes: by first block, and ties by the cover sample's ranks."""
    starts = starts[np.argsort(block[starts], kind="stable")]
    b = block[starts]
    new = np.ones(len(b), bool)
    new[1:] = b[1:] != b[:-1]
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    place = np.flatnonzero(new)[group]
    tied = np.flatnonzero(size[group] > 1)
    if not len(tied):
        return starts
    residue = starts[tied] % V
    members = [tied[residue == r] for r in range(V)]
    for a in range(V):
        for c in range(a, V):
            x, y = members[a], members[c]
            if not len(x) or not len(y):
                continue
            shift = _SHIFT[a, c]
            kx = group[x] << 32 | sample[starts[x] + shift]
            ky = group[y] << 32 | sample[starts[y] + shift]
            for mine, own, other in ((x, kx, ky), (y, ky, kx))[: 1 + (a != c)]:
                other = np.sort(other)
                place[mine] += np.searchsorted(other, own) - np.searchsorted(other, group[mine] << 32)
    out = np.empty(len(starts), np.int64)
    out[place] = starts
    return out


def sorted_buckets(tokens: np.ndarray, starts: np.ndarray, bucket: int = BUCKET) -> Iterator[np.ndarray]:
    """The suffixes at starts, in order, bucket by bucket. Every start has V tokens after it."""
    block = block_ranks(tokens)
    sample = sample_ranks(block)
    first = block[starts]
    ladder = np.sort(first)
    low = -1
    for k in range(bucket, len(ladder) + bucket, bucket):
        high = ladder[min(k, len(ladder)) - 1]
        if high > low:
            yield sort_bucket(starts[(first > low) & (first <= high)], block, sample)
        low = high


def anchors(w: Words, min_words: int, anchor: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, anchor hashes, first starts, last starts) for the texts of at least min_words words.

    A segment is a maximal range of starts of runs of min_words words that have the same anchor hash.
    """
    if not len(w.hash):
        return
    sums = run_sums(w.hash)
    grams = np.full(len(w.hash), np.uint64(2**64 - 1))
    at = np.arange(len(w.hash) - anchor + 1)
    grams[: len(at)] = run_hash(sums, at, anchor) if len(at) else 0
    width = min_words - anchor + 1
    low, reach = grams, 1  # low[i]: the least of grams[i : i + reach]; a window of any width is two such, overlapping
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(grams) - width + 1], low[width - reach : width - reach + len(grams) - width + 1])
    for d in np.flatnonzero(np.diff(w.first) >= min_words):
        s, e = w.first[d], w.first[d + 1] - min_words + 1
        own = low[s:e]
        cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        yield int(d), own[cuts], cuts, np.append(cuts[1:], len(own)) - 1


def _anchor_rows(texts: DataFrame, min_words: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in chunks(batches):
            w = words(chunk)
            found = list(anchors(w, min_words, anchor))
            if found:
                sizes = [len(h) for _, h, *_ in found]
                h = np.concatenate([h for _, h, *_ in found])
                doc = np.repeat(np.array([d for d, *_ in found], np.int64), sizes)
                # A text that repeats itself may hold an anchor twice within one segment; it counts twice then.
                salt = mix(np.arange(len(chunk), dtype=np.uint64) + np.uint64(1))
                at = np.arange(len(w.hash) - anchor + 1)
                grams = np.sort(run_hash(run_sums(w.hash), at, anchor) ^ salt[w.doc[at]])
                twice = np.isin(h ^ salt[doc], grams[1:][grams[1:] == grams[:-1]])
                h, doc = np.concatenate((h, h[twice])), np.concatenate((doc, doc[twice]))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array(ids, np.int64)[doc])], ["anchor", "doc_id"])

    return texts.mapInArrow(run, "anchor long, doc_id long")


def _segments(texts: DataFrame, min_words: int, anchor: int) -> DataFrame:
    """texts: (doc_id, text, anchors). A segment's words are those of all the runs that begin in it, 4 bytes of hash each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            row = 0
            for ids, chunk in chunks(iter([batch.select([0, 1])])):
                w = words(chunk)
                token = (w.hash & np.uint64(0xFFFFFFFF)).astype("<u4")
                out: tuple[list, list, list, list, list] = ([], [], [], [], [])
                for d, h, lo, hi in anchors(w, min_words, anchor):
                    h = h.view(np.int64)
                    keep = np.flatnonzero(np.isin(h, wanted[row + d].values.to_numpy()))
                    base = w.first[d]
                    out[0].extend(h[keep].tolist())
                    out[1].extend([ids[d]] * len(keep))
                    out[2].extend(lo[keep].tolist())
                    out[3].extend((hi - lo + 1)[keep].tolist())
                    out[4].extend(token[base + a : base + b + min_words].tobytes() for a, b in zip(lo[keep], hi[keep]))
                row += len(ids)
                for k in range(0, len(out[0]), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 5000], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["anchor", "doc_id", "start", "runs", "words"])

    return texts.mapInArrow(run, "anchor long, doc_id long, start int, runs int, words binary")


def repeated_starts(doc: np.ndarray, start: np.ndarray, runs: np.ndarray, texts: list[bytes], min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset in it, smallest doc of the group): starts of runs of min_words words that aren't the first of their kind."""
    sizes = np.array([len(t) // 4 + 1 for t in texts], np.int64)  # a mark that occurs once ends each segment
    offset = np.concatenate(([0], np.cumsum(sizes)))
    tokens = np.empty(offset[-1], np.int64)
    mark = np.zeros(offset[-1], bool)
    mark[offset[1:] - 1] = True
    tokens[~mark] = np.frombuffer(b"".join(texts), "<u4").astype(np.int64) + len(texts)
    tokens[mark] = np.arange(len(texts))
    segment = np.repeat(np.arange(len(texts)), runs)
    inner = np.arange(len(segment)) - np.repeat(np.cumsum(runs) - runs, runs)
    begins = offset[:-1][segment] + inner
    of = np.empty(offset[-1], np.int64)
    of[begins] = np.arange(len(begins))
    sums = run_sums(tokens.astype(np.uint64) + np.uint64(1))
    out = []
    tail = np.empty(0, np.int64)
    for bucket in sorted_buckets(tokens, begins):
        h = run_hash(sums, bucket, min_words)  # neighbours share min_words words if these are equal
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        i, g = of[bucket[many]], group[many]
        d, at = doc[segment[i]], start[segment[i]] + inner[i]
        order = np.lexsort((at, d, g))
        i, g, d = i[order], g[order], d[order]
        lead = np.ones(len(g), bool)
        lead[1:] = g[1:] != g[:-1]
        least = d[np.flatnonzero(lead)][np.cumsum(lead) - 1] if len(g) else tail
        out.append((i[~lead], least[~lead]))
    i = np.concatenate([x for x, _ in out] or [tail])
    first = np.concatenate([x for _, x in out] or [tail])
    order = np.argsort(i)
    return segment[i[order]], inner[i[order]], first[order]


def _ranges(segments: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, start, end, first_id) of each segment's words that aren't the first of their kind; sorted by anchor within partitions."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        doc, start, runs = (t.column(c).to_numpy() for c in ("doc_id", "start", "runs"))
        seg, inner, first = repeated_starts(doc, start.astype(np.int64), runs.astype(np.int64), t.column("words").to_pylist(), min_words)
        # A range ends where the next repeated start isn't within reach of the last one, or with its segment.
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (inner[1:] > inner[:-1] + min_words)
        lead = np.flatnonzero(new)
        last = np.append(lead[1:], len(seg)) - 1 if len(seg) else lead
        least = np.minimum.reduceat(first, lead) if len(seg) else first
        return pa.RecordBatch.from_arrays([pa.array(doc[seg[lead]]), pa.array(start[seg[lead]] + inner[lead], pa.int64()), pa.array(start[seg[lead]] + inner[last] + min_words, pa.int64()), pa.array(least)], ["doc_id", "start", "end", "first_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            if not len(b):
                continue
            key = b.column(0).to_numpy()
            if size >= STEP_WORDS:
                edge = int(np.searchsorted(key != last, True)) if key[0] == last else 0
                if edge < len(b):
                    if edge:
                        held.append(b.slice(0, edge))
                    yield solve(held)
                    held, size, b = [], 0, b.slice(edge)
            held.append(b)
            size += b.column(4).nbytes // 4
            last = key[-1]
        if held:
            yield solve(held)

    return segments.mapInArrow(run, "doc_id long, start long, end long, first_id long")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, start_word, end_word, first_id): maximal ranges of words (end exclusive) covered by repeated runs.

    Words are runs of bytes other than ASCII white space, counted from 0. Of equal runs of min_words words
    the one first by (doc_id, position) isn't listed, all others are; first_id is the smallest doc_id that
    holds a first one for the range. A document may repeat itself. Null, empty and shorter texts have no runs.
    Rows without an id are left out; other columns are ignored. If rows repeat an id, all of them count as that document's.
    """
    texts = text_frame(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    seen = _anchor_rows(texts, min_words, anchor)
    again = seen.withColumn("n", F.count("*").over(W.partitionBy("anchor"))).filter("n > 1").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    segments = _segments(texts.join(again, "doc_id").select("doc_id", "text", "anchors"), min_words, anchor)
    ranges = _ranges(segments.repartition("anchor").sortWithinPartitions("anchor"), min_words)
    by_doc = W.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    islands = ranges.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("first_id").alias("first_id")).drop("island")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\t\n\x0b\f\r ]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM w WHERE len(w) >= 50),
k AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1 : pos + 50], ' ')) AS run FROM r),
f AS (SELECT doc_id, pos, first_value(doc_id) OVER x AS from_id, row_number() OVER x AS n FROM k WINDOW x AS (PARTITION BY run ORDER BY doc_id, pos)),
g AS (SELECT doc_id, pos, from_id, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS new FROM f WHERE n > 1),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT doc_id, min(pos) AS start_word, max(pos) + 50 AS end_word, min(from_id) AS first_id FROM i GROUP BY doc_id, island
"""
