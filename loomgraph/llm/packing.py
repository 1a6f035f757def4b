"""Related-document packing: training windows that hold neighbouring documents.

1. Each text becomes a point: its hashed word counts, damped and normalised. Nearness is that of these
   whole profiles. Documents of one profile are one point; they follow one another.
2. Centres of a sample part the points into cells of some thousand, dense ones too. Every point is compared with all
   points of its own cell and of those, PROBES in all, that promise the nearest points: a tight cell promises what is at
   its centre, a loose one also what lies off it. With no more cells than that the graph is exact.
3. Neighbouring cells make regions of up to REGION points. In each, paths start at the unvisited point of lowest
   degree and step to the nearest unvisited neighbour until there is none; the next path follows.
4. Windows of a fixed number of tokens are filled along the paths; a document that doesn't fit is continued in
   the next window, so no token is lost or padded except in a region's last window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import chunks, cut, text_frame
from .kernel import words

BUCKETS = 256
NEIGHBOURS = 6
WINDOW = 2048
CELL = 3000
#: Cells that each point looks through. README has the recall measured with it.
PROBES = 12
#: A task compares points with at most so many of a cell, and so many points with them; cells that are larger or more looked at are dealt to several.
OWN, LOOKING = 20_000, 100_000
#: Points whose paths a task walks.
REGION = 100_000
#: Points from which the centres are made: so many a cell, within these bounds.
CENTRE_POINTS, LEAST_POINTS, MOST_POINTS = 32, 4096, 50_000
#: Cells of more than so many times the mean of the sample's points are parted, in so many rounds at most.
LARGE, SPLITS = 4, 60
#: How far off the centres' plane the nearest of a cell's points reach towards a point, as a share of what both have off it.
SPREAD = 0.3
#: Parts that the documents of one profile are dealt to for their order.
SALT = 64


def word_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of each text's words by hash bucket."""
    w = words(texts, fold=True)
    return np.bincount(w.doc * np.int64(BUCKETS) + (w.hash >> np.uint64(56)).astype(np.int64), minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def _unit(counts: np.ndarray) -> np.ndarray:
    p = np.sqrt(counts.astype(np.float32))
    n = np.sqrt((p * p).sum(axis=1, keepdims=True))
    return p / np.where(n > 0, n, 1)


def profiles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word counts, rows of unit length: square roots of the counts of words by hash bucket). A text without words has zeros."""
    counts = word_counts(texts)
    return counts.sum(axis=1), _unit(counts)


def tokens_of(texts: list[str | None]) -> np.ndarray:
    """A text's tokens, as packing counts them: its runs of characters other than ASCII white space."""
    return np.diff(words(texts).first)


def vectors(texts: DataFrame) -> DataFrame:
    """(doc_id, n, v): tokens and word counts of each row; v has the counts' lowest bytes first, then the next as far as a count has any, so that it is short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens_of(chunk)), _as_bytes(word_counts(chunk))], ["doc_id", "n", "v"])

    return texts.mapInArrow(run, "doc_id long, n long, v binary")


def _as_bytes(counts: np.ndarray) -> pa.Array:
    planes = np.ascontiguousarray(counts, "<u4").view(np.uint8).reshape(len(counts), BUCKETS, 4).transpose(0, 2, 1)
    most = counts.max(axis=1)
    used = 1 + sum((most >> 8 * k > 0).astype(int) for k in (1, 2, 3))
    return pa.array([row[:n].tobytes() for row, n in zip(planes, used)], pa.binary())


def _counts(v: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The word counts that _as_bytes() packed."""
    rows = v.to_pylist()
    if max(map(len, rows), default=0) <= BUCKETS:
        return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), BUCKETS)
    raw = np.frombuffer(b"".join(r.ljust(4 * BUCKETS, b"\0") for r in rows), np.uint8)
    return np.ascontiguousarray(raw.reshape(len(rows), 4, BUCKETS).transpose(0, 2, 1)).view("<u4")[:, :, 0]


def _as_rows(v: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Profiles of v."""
    return _unit(_counts(v))


def centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit vectors, one a cell, near which the sample's points lie: spherical k-means from a fixed start, and again within cells of over LARGE times the mean size until there are none."""
    if not len(sample):
        return np.zeros((1, BUCKETS), np.float32)
    most = LARGE * max(1, len(sample) // max(1, cells))
    c = _k_means(sample, cells, rounds)
    for _ in range(SPLITS):
        near = _nearest_of(sample, c)
        size = np.bincount(near, minlength=len(c))
        large = np.flatnonzero((size > most) & (size < len(sample)))
        if not len(large):
            break
        c = np.concatenate([c[np.setdiff1d(np.arange(len(c)), large)], *(_k_means(sample[near == k], -(-2 * size[k] // most), rounds) for k in large)])
    return c


def tightness(sample: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """The mean product of each cell's points with its centre; that of all points where the sample has none."""
    near = _nearest_of(sample, middle) if len(sample) else np.empty(0, np.int64)
    n, along = np.bincount(near, minlength=len(middle)), (sample * middle[near]).sum(axis=1)
    total = np.bincount(near, along, minlength=len(middle))
    return np.clip(np.where(n > 0, total / np.maximum(n, 1), along.mean() if len(along) else 1), 0, 1).astype(np.float32)


def cells_of(x: np.ndarray, middle: np.ndarray, tight: np.ndarray, probes: int) -> np.ndarray:
    """For each of x the cell of the nearest centre, and then the others of the `probes` that promise the nearest points, best first.

    What a cell promises is the product with its mean point, and SPREAD of the product of the parts of both off its centre.
    """
    s = x @ middle.T
    home = s.argmax(axis=1)
    promise = s * tight + SPREAD * np.sqrt(1 - tight * tight) * np.sqrt(np.maximum(0, 1 - s * s))
    promise[np.arange(len(x)), home] = np.inf
    near = np.argpartition(-promise, probes - 1, axis=1)[:, :probes] if probes < len(middle) else np.tile(np.arange(probes), (len(x), 1))
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(promise, near, 1), axis=1, kind="stable"), 1)


def _nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[lo : lo + 4096] @ c.T).argmax(axis=1) for lo in range(0, len(x), 4096)])


def _k_means(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    c = sample[np.random.default_rng(7).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds if len(c) > 1 else 0):
        near = _nearest_of(sample, c)
        order = np.argsort(near, kind="stable")
        start = np.flatnonzero(np.diff(near[order], prepend=-1))
        total = np.add.reduceat(sample[order], start, axis=0)
        length = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c[near[order][start]] = total / np.where(length > 0, length, 1)
    return c


def _true(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero() of a matrix with few true cells, in a fraction of its time."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _nearest(q: np.ndarray, row: np.ndarray, y: np.ndarray, col: np.ndarray, ids: np.ndarray, k: int, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo + index into q, id, squared distance) of the k nearest of the pairs q[row], y[col], by (distance in double precision, col)."""
    d = np.empty(len(row))
    for a in range(0, len(row), 256):  # in the cache
        gap = np.subtract(q[row[a : a + 256]], y[col[a : a + 256]], dtype=np.float64)
        d[a : a + 256] = np.einsum("ij,ij->i", gap, gap)
    order = np.lexsort((col, d, row))
    row, col, d = row[order], col[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return lo + row[keep], ids[col[keep]], d[keep]


def most_alike(x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into x, id, squared distance) of the k nearest of y (ids ascending) for each of x, by (distance, id), but for its own row. All have unit length.

    Products in single precision, of blocks that stay in the cache, choose twice k rows; the distances of those that may be among the k are then computed in double precision.
    """
    found = []
    most = min(2 * k, len(y))
    at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
    mine = np.where(ids[at] == own, at, -1) if len(ids) else np.empty(0, np.int64)
    for lo in range(0, len(x) if len(y) else 0, 512):
        q = x[lo : lo + 512]
        me = mine[lo : lo + 512]
        n = len(q)
        best, score = np.empty((n, 0), np.int64), np.empty((n, 0), np.float32)
        if len(y) <= 2048:  # one block: those that may be among the k at once
            s = q @ y.T
            here = np.flatnonzero(me >= 0)
            s[here, me[here]] = -2
            kth = np.partition(s, len(y) - k, axis=1)[:, len(y) - k, None] if len(y) > k else np.float32(-2)
            row, col = _true((s >= kth - 1e-4) & (s > -2))
            found.append(_nearest(q, row, y, col, ids, k, lo))
            continue
        for b in range(0, len(y), 2048):
            s = q @ y[b : b + 2048].T
            here = np.flatnonzero((me >= b) & (me < b + s.shape[1]))
            s[here, me[here] - b] = -2
            if not best.shape[1]:
                if s.shape[1] > most:
                    kth = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most, None]
                    row, col = _true(s >= kth - 1e-5)
                else:
                    row, col = _true(s > -3)
                v = s[row, col]
            else:
                row, col = _true(s > score[:, -1:] - 1e-5)
                if not len(row):
                    continue
                v = np.concatenate((score.ravel(), s[row, col]))
                row, col = np.concatenate((np.repeat(np.arange(n), best.shape[1]), row)), np.concatenate((best.ravel(), col + b))
            order = np.lexsort((col, -np.round(v, 5), row))
            row, col, v = row[order], col[order], v[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < most
            if keep.sum() == n * most:
                best, score = col[keep].reshape(n, most), v[keep].reshape(n, most)
            else:  # fewer rows than that so far
                best, score = np.zeros((n, most), np.int64), np.full((n, most), -2, np.float32)
                best[row[keep], rank[keep]], score[row[keep], rank[keep]] = col[keep], v[keep]
        row, place = np.nonzero((score > -2) & (score >= score[:, min(k, most) - 1, None] - 1e-4))  # the others are farther than k of these
        found.append(_nearest(q, row, y, best[row, place], ids, k, lo))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, int), np.empty(0, np.int64), np.empty(0))


def regions(middle: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(first region, regions) of each cell: cells near each other share a region while they hold `limit` points or fewer; a larger cell has several of its own."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // limit))
    made = 0
    stack = [np.arange(len(sizes))]
    while stack:
        own = stack.pop()
        if len(own) == 1 or sizes[own].sum() <= limit:
            first[own] = made
            made += int(parts[own].max(initial=1)) if len(own) == 1 else 1
            if len(own) > 1:
                parts[own] = 1
            continue
        x = middle[own].astype(float)
        x -= x.mean(axis=0)
        axis = np.linalg.svd(x, full_matrices=False)[2][0]
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        own = own[np.argsort(x @ axis, kind="stable")]
        half = int(np.searchsorted(np.cumsum(sizes[own]), sizes[own].sum() / 2))
        half = min(max(1, half), len(own) - 1)
        stack += [own[half:], own[:half]]
    return first, parts


def neighbours(pts: DataFrame, k: int = NEIGHBOURS, cell_size: int = CELL, probes: int = PROBES, region: int = REGION, own: int = OWN, looking: int = LOOKING) -> tuple[DataFrame, DataFrame]:
    """(doc_id, region) of each of pts (doc_id, v), and edges (doc_id, other, rank, d2): the k nearest others found in `probes` cells; ties go to the smaller id.

    A point without words has no neighbours.
    """
    total = pts.count()
    cells = max(1, -(-total // cell_size))
    share = min(1.0, min(MOST_POINTS, max(LEAST_POINTS, CENTRE_POINTS * cells)) / max(1, total))
    sample = pts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "v").toArrow().sort_by("doc_id")
    drawn = _as_rows(sample["v"])
    middle = centres(drawn, cells)
    tight = tightness(drawn, middle)
    probed = min(probes, len(middle))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                c = b.slice(lo, 2000)
                near = cells_of(_as_rows(c.column("v")), middle, tight, probed)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("v"), pa.array(near.astype("<i4").reshape(-1)[::probed]), pa.array([r.tobytes() for r in near.astype("<i4")], pa.binary())], ["doc_id", "v", "cell", "near"])

    placed = cut(pts.select("doc_id", "v").mapInArrow(place, "doc_id long, v binary, cell int, near binary"))
    sizes, looks = np.zeros(len(middle), np.int64), np.zeros(len(middle), np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, len(middle)), np.int64)
        for b in batches:
            n[0] += np.bincount(b.column(0).to_numpy(), minlength=len(middle))
            n[1] += np.bincount(np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4"), minlength=len(middle))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(middle), dtype=np.int32)), pa.array(n[0]), pa.array(n[1])], ["cell", "own", "looks"])

    counted = placed.select("cell", "near").mapInArrow(tally, "cell int, own long, looks long").groupBy("cell").agg(F.sum("own").alias("own"), F.sum("looks").alias("looks")).toArrow()  # a row a cell
    sizes[counted["cell"].to_numpy()], looks[counted["cell"].to_numpy()] = counted["own"].to_numpy(), counted["looks"].to_numpy()
    blocks, parts = np.maximum(1, -(-sizes // own)), np.maximum(1, -(-looks // looking))
    first, many = regions(middle, sizes, region)
    group, _ = regions(middle, looks, looking)  # cells near each other go to one task, so the copies of a point lie side by side in what is shuffled

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first[cell] + b.column(0).to_numpy() % many[cell])], ["doc_id", "region"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                c = b.slice(lo, 1000)
                ids, cell = c.column("doc_id").to_numpy(), c.column("cell").to_numpy()
                near = np.frombuffer(b"".join(c.column("near").to_pylist()), "<i4").reshape(len(c), -1)
                row = np.flatnonzero(_counts(c.column("v")).any(axis=1))
                # Its own cell's block in each part of those that look, and a part in each block of the cells it looks through.
                a = np.repeat(row, parts[cell[row]])
                ka = cell[a], ids[a] % blocks[cell[a]], np.arange(len(a)) - np.searchsorted(a, a)
                q = np.repeat(row, near.shape[1])
                to = near[row].ravel()
                z = np.repeat(np.arange(len(q)), blocks[to])
                kz = to[z], np.arange(len(z)) - np.searchsorted(z, z), ids[q[z]] % parts[to[z]]
                who = np.concatenate((a, q[z]))
                key = [np.concatenate((p, r)).astype(np.int32) for p, r in zip(ka, kz)]
                key = [pa.array(z) for z in (group[key[0]] + key[2], *key)]
                yield pa.RecordBatch.from_arrays([c.column("doc_id").take(pa.array(who)), c.column("v").take(pa.array(who)), *key, pa.array(np.arange(len(who)) >= len(a))], ["doc_id", "v", "grp", "cell", "block", "part", "looks"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, y, ids = None, [], []
        for b in batches:
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("cell", "block", "part")] + [b.column("looks").to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True]))) if len(b) else []
            for lo, hi in zip(edge[:-1], edge[1:]):
                x, mine = _as_rows(b.column("v").slice(lo, hi - lo)), b.column("doc_id").to_numpy()[lo:hi]
                if tuple(key[lo, :3]) != now:
                    now, y, ids = tuple(key[lo, :3]), [], []
                if not key[lo, 3]:
                    y.append(x)
                    ids.append(mine)
                elif y:
                    if len(y) > 1:
                        y, ids = [np.concatenate(y)], [np.concatenate(ids)]
                    row, other, d = most_alike(x, mine, y[0], ids[0], k)
                    yield pa.RecordBatch.from_arrays([pa.array(mine[row]), pa.array(other), pa.array(d)], ["doc_id", "other", "d2"])

    dealt = placed.mapInArrow(deal, "doc_id long, v binary, grp long, cell int, block int, part int, looks boolean")
    met = dealt.repartition("grp", "block").sortWithinPartitions("cell", "block", "part", "looks", "doc_id").mapInArrow(look, "doc_id long, other long, d2 double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("d2", "other"))), 1, k)  # of k a cell and block
    edges = met.groupBy("doc_id").agg(best.alias("z")).select("doc_id", F.posexplode("z").alias("rank", "e")).select("doc_id", F.col("e.other").alias("other"), "rank", F.col("e.d2").alias("d2"))
    return placed.select("doc_id", "cell").mapInArrow(home, "doc_id long, region long"), edges


def walk(ids: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray, degree: np.ndarray) -> list[list[int]]:
    """Paths over the nodes 0 .. len(ids)-1 (in the order of their ids) along undirected edges a-b: each starts at the unvisited
    node of lowest (degree, id) and steps to the nearest unvisited neighbour (distance, id). Every node is on one path."""
    ends = np.concatenate((a, b))
    far = np.concatenate((b, a))
    length = np.concatenate((d, d))
    order = np.lexsort((far, length, ends))
    far = far[order].tolist()
    at = np.searchsorted(ends[order], np.arange(len(ids) + 1)).tolist()
    seen = [False] * len(ids)
    paths = []
    for start in np.lexsort((ids, degree)).tolist():
        if seen[start]:
            continue
        path, node = [], start
        while node >= 0:
            seen[node] = True
            path.append(node)
            node = next((f for f in far[at[node] : at[node + 1]] if not seen[f]), -1)
        paths.append(path)
    return paths


def paths(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, region, path, start): where each of points (doc_id, region, tokens) stands in its region's order, start being the tokens before it.

    Degrees are those in the whole graph; a path ends where all unvisited neighbours are in other regions.
    """
    degree = edges.select("doc_id", "other").unionAll(edges.select("other", "doc_id")).toDF("doc_id", "other").distinct().groupBy("doc_id").agg(F.count("*").alias("degree"))
    nodes = points.join(degree, "doc_id", "left").select("region", "doc_id", "tokens", F.coalesce("degree", F.lit(0)).alias("degree"))
    home = lambda node, name: points.select(F.col("doc_id").alias(node), F.col("region").alias(name))
    own = edges.join(home("doc_id", "inside"), "doc_id").join(home("other", "to"), "other").filter("inside = to").select("inside", "doc_id", "other", "d2")

    def solve(key: tuple, node: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("doc_id")
        ids, size = node["doc_id"].to_numpy(), node["tokens"].to_numpy()
        a, b = np.searchsorted(ids, edge["doc_id"].to_numpy()), np.searchsorted(ids, edge["other"].to_numpy())
        found = walk(ids, a, b, edge["d2"].to_numpy(), node["degree"].to_numpy())
        order = np.array([i for p in found for i in p], np.int64)
        end = np.cumsum(size[order])
        return pd.DataFrame({"doc_id": ids[order], "region": key[0], "path": np.repeat(np.arange(len(found)), [len(p) for p in found]), "start": end - size[order]})

    return nodes.groupBy("region").cogroup(own.groupBy("inside")).applyInPandas(solve, "doc_id long, region long, path int, start long")


def pack_related(docs: DataFrame, window: int = WINDOW, k: int = NEIGHBOURS, cell_size: int = CELL, region: int = REGION) -> DataFrame:
    """(window_id, position, path, doc_id, token_start, token_end): the pieces of documents in each window, in order.

    window_id is unique and stable for given input: the region in the upper 32 bits, the window within it in the lower.
    Every token of every document is in exactly one piece. Texts without tokens (null or empty) take no place
    and are in no window; rows without an id are left out; of rows that repeat an id, the one with the most tokens
    counts (with the last profile, by bytes, if these tie too). Documents of one profile, however many, follow one another.
    Very long texts are taken whole; other columns are ignored.
    """
    texts = text_frame(docs).filter("doc_id IS NOT NULL")
    own = cut(vectors(texts).filter("n > 0").groupBy("doc_id").agg(F.max(F.struct("n", "v")).alias("p")).select("doc_id", "p.*", F.xxhash64("p.v").alias("a"), F.xxhash64(F.lit(7), "p.v").alias("b")))
    points = cut(own.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.any_value("v").alias("v"), F.sum("n").alias("tokens")))
    homes, edges = neighbours(points.select("doc_id", "v"), k, cell_size, region=region)
    placed = points.select("doc_id", "tokens", "a", "b").join(homes, "doc_id")
    walked = paths(placed.select("doc_id", "region", "tokens"), cut(edges)).join(points.select("doc_id", "a", "b"), "doc_id").drop("doc_id")
    # Among the documents of a profile: by a part of SALT, then by id, so that no task has to order all of them.
    dealt = own.select("doc_id", "n", "a", "b", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).alias("salt"))
    ahead = W.partitionBy("a", "b").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy("a", "b", "salt").agg(F.sum("n").alias("m")).withColumn("ahead", F.coalesce(F.sum("m").over(ahead), F.lit(0))).drop("m")
    here = W.partitionBy("a", "b", "salt").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = dealt.join(before.join(walked, ["a", "b"]), ["a", "b", "salt"]).withColumn("from", F.col("start") + F.col("ahead") + F.coalesce(F.sum("n").over(here), F.lit(0)))
    w = F.lit(window).cast("long")
    last = F.col("from") + F.col("n") - 1
    pieces = rows.select("region", "path", "doc_id", "n", "from", F.explode(F.sequence(F.expr(f"from DIV {window}"), F.floor(last / w))).alias("w"))
    start, end = F.greatest(F.col("w") * w - F.col("from"), F.lit(0)), F.least((F.col("w") + 1) * w - F.col("from"), F.col("n"))
    out = pieces.select((F.shiftleft("region", 32) + F.col("w")).alias("window_id"), "path", "doc_id", start.alias("token_start"), end.alias("token_end"), "from")
    position = F.row_number().over(W.partitionBy("window_id").orderBy("from")) - 1
    return out.select("window_id", position.alias("position"), "path", "doc_id", "token_start", "token_end")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_related() of all documents: a row a piece; null and empty texts have none."""
    return pack_related(spark.read.parquet(f"{sf_dir}/documents.parquet"))
