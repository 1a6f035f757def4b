"""Near-duplicate detection: SimHash fingerprints compared around the anchors of a covering code.

A fingerprint is BLOCKS blocks of 23 bits, to which all words of a text count, by their
length and the root of their count. The anchors of a block are the 4096 words of the binary Golay code, whose covering
radius is 3 (it is perfect: each value is within 3 of exactly one anchor). A fingerprint looks at
every anchor within 3 + 2 of its block, and is to be found at those within 3 + 1. If two fingerprints differ by at most
THRESHOLD = 1 + 2 bits in some block, there is a value 1 bit from the one and 2 from the other, and the anchor within 3 of that
value has both, so they are compared there. By the pigeonhole principle no pair within (THRESHOLD + 1) * BLOCKS - 1 bits
is ever missed, and that is more than MAX_BITS. Pairs compared are near-duplicates if they differ by at most MAX_BITS in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import chunks, cut, fresh_name, text_frame
from .kernel import mix, words

BLOCKS = 8
BLOCK_BITS = 23
RADIUS = 3
#: How far beyond RADIUS a fingerprint is to be found and looks; pairs within the sum of both in some block meet.
FOUND, LOOKS = 1, 2
THRESHOLD = FOUND + LOOKS
#: Of the 184 bits. Copies with 4 % of their words replaced differ by about 13; no pair within this is missed.
MAX_BITS = 30
#: A word's weight grows with its length up to this many bytes: short ones are the same in all texts of a language.
FULL_WEIGHT = 8
#: Records that a task compares at once; anchors with more are dealt to several.
GROUP_RECORDS = 1_000_000
#: Neighbouring anchors that a group has at most. A fingerprint is sent once to a group, whichever of its anchors are near.
SPAN = 512
#: Removed ids up to this many bytes are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_GENERATOR = 0b110001110101
_MASK = (1 << BLOCK_BITS) - 1
#: place: the anchor, or if span isn't 0 the first of so many among which the task finds those that are near.
_WIRE = np.dtype([("place", "<u2"), ("span", "<u2"), ("home", "u1"), ("looks", "u1"), ("id", "<i8"), ("f", "<u8", (3,))])


def _remainder(value: int) -> int:
    for bit in range(BLOCK_BITS - 1, 10, -1):
        if value >> bit & 1:
            value ^= _GENERATOR << (bit - 11)
    return value


@lru_cache(maxsize=1)
def covering() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome tables for 3 bytes, offsets by syndrome, errors, weights): the errors of weight up to RADIUS + LOOKS."""
    tables = np.array([[_remainder(b << (8 * k) & _MASK) for b in range(256)] for k in range(3)], np.uint32)
    errors = [sum(1 << i for i in c) for n in range(RADIUS + LOOKS + 1) for c in combinations(range(BLOCK_BITS), n)]
    syndrome = np.array([_remainder(e) for e in errors])
    order = np.argsort(syndrome, kind="stable")
    e = np.array(errors, np.uint32)[order]
    return tables, np.searchsorted(syndrome[order], np.arange(2049)), e, np.bitwise_count(e)


def near_anchors(block: np.ndarray, home: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into block, anchor, whether it is within `home`) for the anchors within RADIUS + LOOKS of each value."""
    tables, offset, errors, weight = covering()
    s = tables[0][block & 0xFF] ^ tables[1][block >> 8 & 0xFF] ^ tables[2][block >> 16]
    n = offset[s + 1] - offset[s]
    row = np.repeat(np.arange(len(block)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offset[s], n)
    return row, (block[row] ^ errors[at]) >> 11, weight[at] <= home


def block_of(f: np.ndarray, k: int) -> np.ndarray:
    """Bits 23 k .. 23 k + 22 of fingerprints given as rows of three 64-bit words."""
    word, shift = divmod(k * BLOCK_BITS, 64)
    v = f[:, word] >> np.uint64(shift)
    if shift + BLOCK_BITS > 64:
        v = v | f[:, word + 1] << np.uint64(64 - shift)
    return (v & np.uint64(_MASK)).astype(np.uint32)


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the texts that have words, their fingerprints as rows of three 64-bit words).

    Each distinct word votes with the 184 bits of its hash; its weight rises with its length and the root of its
    count. A bit is set if more than half of the weight sets it. Very long texts vote with all their words.
    """
    w = words(texts, fold=True)
    have = np.flatnonzero(np.diff(w.first))
    if not len(have):
        return have, np.empty((0, 3), np.uint64)
    key = w.hash ^ mix(w.doc.astype(np.uint64))
    order = np.argsort(key)
    lead = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]])))
    first, count = order[lead], np.diff(np.append(lead, len(key)))
    order = np.argsort(w.doc[first], kind="stable")
    first, count = first[order], count[order]
    weight = np.round(4 * (4 + np.minimum(w.length[first], FULL_WEIGHT)) * np.sqrt(count))
    h = w.hash[first]
    edge = np.append(np.searchsorted(w.doc[first], have), len(h)).tolist()
    half = np.add.reduceat(weight, edge[:-1]) / 2
    out = np.zeros((len(have), 24), np.uint8)
    for k in range(3):
        bits = mix(h + np.uint64(k * 0x51ED2701)).view(np.uint8).reshape(-1, 8)
        votes = np.empty((len(have), 64))
        for i, (lo, hi) in enumerate(zip(edge, edge[1:])):  # whole numbers, so sums are exact in either precision
            kind = np.float32 if half[i] < 1 << 22 else np.float64
            votes[i] = weight[lo:hi].astype(kind) @ np.unpackbits(bits[lo:hi], axis=1).astype(kind)
        out[:, 8 * k : 8 * k + 8] = np.packbits(votes > half[:, None], axis=1)
    f = out.view("<u8").astype(np.uint64)
    f[:, 2] &= np.uint64((1 << (BLOCKS * BLOCK_BITS - 128)) - 1)
    return have, f


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n items and edges a-b, the least item that each is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _spread(at: np.ndarray) -> np.ndarray:
    """Records of spans as those of their anchors; the others as they are."""
    wide = at["span"] > 0
    sets = [at[~wide]]
    for lo in range(0, len(at), 20_000):
        part = at[lo : lo + 20_000][wide[lo : lo + 20_000]]
        for first in np.unique(part["place"]):
            own = part[part["place"] == first]
            row, anchor, home = near_anchors(block_of(own["f"], int(first) >> 12), RADIUS + FOUND)
            place = anchor | int(first) >> 12 << 12
            inside = (place >= first) & (place < int(first) + own["span"][row])
            new = own[row[inside]]
            new["place"], new["span"], new["home"] = place[inside], 0, home[inside]
            sets.append(new)
    return np.concatenate(sets)


def compare(at: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id connected with it) among the records of some anchors, where these differ. Of a pair, the lesser id is one to be found.

    Pairs are folded into connected sets a step at a time, so memory grows with the records and not with the pairs.
    """
    at = _spread(at)
    at = at[np.lexsort((at["id"], at["place"]))]
    ids, item = np.unique(at["id"], return_inverse=True)
    label = np.arange(len(ids))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def fold() -> None:
        nonlocal label, size
        a, b = (label[np.concatenate(x)] for x in zip(*held))
        label = forest(a, b, len(ids))[label]
        held.clear()
        size = 0

    border = np.flatnonzero(np.concatenate(([True], at["place"][1:] != at["place"][:-1], [True])))
    for lo, hi in zip(border[:-1], border[1:]):
        home = np.flatnonzero(at["home"][lo:hi])
        looks = np.flatnonzero(at["looks"][lo:hi])
        if not len(home) or len(looks) < 1:
            continue
        own = at["f"][lo:hi]
        value = block_of(own, int(at["place"][lo]) >> 12)
        step = max(1, 500_000 // len(looks))
        for k in range(0, len(home), step):
            x = home[k : k + step]
            y = looks[np.searchsorted(looks, x[0]) :]  # either of a pair may be the one to be found, so greater ids will do
            i, j = np.divmod(np.flatnonzero(np.bitwise_count(value[x][:, None] ^ value[y][None, :]) <= THRESHOLD), max(1, len(y)))
            i, j = x[i], y[j]
            keep = item[i + lo] < item[j + lo]
            i, j = i[keep], j[keep]
            close = distance(own[i], own[j]) <= max_bits
            if close.any():
                held.append((item[i[close] + lo], item[j[close] + lo]))
                size += len(held[-1][0])
                if size > 4_000_000:
                    fold()
    if held:
        fold()
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


def _fingerprint_frame(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in chunks(batches):
            have, f = fingerprints(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[have]), *(pa.array(f[:, k].astype(np.int64)) for k in range(3))], ["doc_id", "f0", "f1", "f2"])

    return texts.mapInArrow(run, "doc_id long, f0 long, f1 long, f2 long")


def _records(f: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What fingerprints send to anchors: all that are near look, and those that are nearer still are looked for."""
    sets = []
    for k in range(BLOCKS):
        row, anchor, home = near_anchors(block_of(f, k), RADIUS + FOUND)
        wire = np.empty(len(row), _WIRE)
        wire["place"], wire["span"], wire["home"], wire["looks"], wire["id"], wire["f"] = anchor | k << 12, 0, home, 1, ids[row], f[row]
        sets.append(wire)
    return np.concatenate(sets)


def _to_spans(f: np.ndarray, ids: np.ndarray, group: np.ndarray, first: np.ndarray, span: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """One record of each fingerprint for each group that has an anchor near it, but for anchors that are alone."""
    sets = []
    for k in range(BLOCKS):
        row, anchor, _ = near_anchors(block_of(f, k))
        at = anchor | k << 12
        keep = ~alone[at]
        least, most = group[k << 12], group[(k + 1 << 12) - 1]
        hit = np.zeros((len(f), most - least + 1), bool)
        hit[row[keep], group[at[keep]] - least] = True
        row, g = np.nonzero(hit)
        g += least
        wire = np.empty(len(row), _WIRE)
        wire["place"], wire["span"], wire["home"], wire["looks"], wire["id"], wire["f"] = first[g], span[g], 1, 1, ids[row], f[row]
        sets.append(wire)
    return np.concatenate(sets)


def _fingerprint_rows(b: pa.RecordBatch, size: int = 2000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo in range(0, len(b), size):
        part = b.slice(lo, size)
        yield part.column(0).to_numpy(), np.stack([part.column(k).to_numpy().view(np.uint64) for k in (1, 2, 3)], axis=1)


def _loads(prints: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(records to be found, records) at each of the BLOCKS * 4096 anchors."""
    places = BLOCKS << 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, near = np.zeros(places, np.int64), np.zeros(places, np.int64)
        for b in batches:
            for _, f in _fingerprint_rows(b):
                for k in range(BLOCKS):
                    _, anchor, own = near_anchors(block_of(f, k), RADIUS + FOUND)
                    near[k << 12 : k + 1 << 12] += np.bincount(anchor, minlength=4096)
                    home[k << 12 : k + 1 << 12] += np.bincount(anchor[own], minlength=4096)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(places, dtype=np.int32)), pa.array(home), pa.array(near)], ["place", "home", "near"])

    t = prints.mapInArrow(run, "place int, home long, near long").groupBy("place").agg(F.sum("home").alias("home"), F.sum("near").alias("near")).toArrow()
    out = np.zeros((2, places), np.int64)
    out[0][t["place"].to_numpy()], out[1][t["place"].to_numpy()] = t["home"].to_numpy(), t["near"].to_numpy()
    return out[0], out[1]


def _to_anchors(prints: DataFrame, limit: int) -> DataFrame:
    """(grp, part, block): the records that a batch sends to the anchors, packed, for groups of up to SPAN neighbouring anchors with `limit` records or fewer.

    An anchor with more is a grid: its records to be found are dealt to rows and those that look to columns, and each cell is a part.
    """
    home, near = _loads(prints)
    total = np.cumsum(near.reshape(-1, SPAN), axis=1).ravel()
    within = (total - near) // max(1, limit)  # of each SPAN anchors one after another, a new group at each further `limit`
    rows, columns = np.maximum(1, -(-2 * home // limit)), np.maximum(1, -(-2 * near // limit))
    alone = (rows > 1) | (columns > 1)
    new = np.concatenate(([True], (within[1:] != within[:-1]) | (np.arange(1, len(near)) % SPAN == 0) | alone[1:] | alone[:-1]))
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    span = np.diff(np.append(first, len(near)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, f in _fingerprint_rows(b):
                every = _to_spans(f, ids, group, first, span, alone)
                sets = [(every, np.zeros(len(every), np.int64))]
                if alone.any():
                    every = _records(f, ids)
                    every = every[alone[every["place"]]]
                    for own, across, along, mark in ((every[every["home"] > 0], columns, rows, "looks"), (every, rows, columns, "home")):
                        p = own["place"]
                        n = across[p]
                        at = np.repeat(np.arange(len(own)), n)
                        i = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                        mine = (mix(own["id"].view(np.uint64)) % along[p].astype(np.uint64)).astype(np.int64)[at]
                        cell = mine * columns[p][at] + i if mark == "looks" else i * columns[p][at] + mine
                        copies = own[at]
                        copies[mark] = 0
                        sets.append((copies, cell + 1))
                wire, part = np.concatenate([w for w, _ in sets]), np.concatenate([p for _, p in sets])
                key = group[wire["place"]]
                order = np.lexsort((wire["place"], part, key))
                wire, part, key = wire[order], part[order], key[order]
                edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[edge[:-1]]), pa.array(part[edge[:-1]]), pa.array([wire[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:])], pa.binary())],
                    ["grp", "part", "block"],
                )

    return prints.mapInArrow(run, "grp long, part long, block binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for the nodes of (a, b) that aren't their component's least: large and small stars in turn, until nothing changes."""
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    known = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", F.min("v").over(W.partitionBy("u")))
        large = both.select("u", "v", least.alias("m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select("u", "v", F.min("v").over(W.partitionBy("u")).alias("m"))
        small = down.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        e = cut(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            return e.select("u", F.col("v").alias("root")).withColumnRenamed("u", "v")
        known = state


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, limit: int = GROUP_RECORDS) -> DataFrame:
    """(doc_id, kept_id): every document that is near another, but for the one kept, and the kept one's id.

    Near-duplicate pairs are joined to groups; the smallest doc_id of a group is kept. Words are compared
    lower-cased and without punctuation. Texts without a word (null, empty, only punctuation) have no
    fingerprint and no copies; rows without an id are left out. Rows that repeat an id are one document. Very long
    texts are taken whole; other columns are ignored. A task compares at most some `limit` records.
    """
    prints = cut(_fingerprint_frame(text_frame(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")))
    f = ["f0", "f1", "f2"]
    # Equal fingerprints are one item, so a text with a million copies is compared once.
    items = prints.withColumn("item", F.min("doc_id").over(W.partitionBy(*f)))
    stars = cut(items.filter("doc_id <> item").select("doc_id", "item").distinct())
    leads = cut(prints.groupBy(*f).agg(F.min("doc_id").alias("doc_id")).select("doc_id", *f))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = compare(np.frombuffer(b"".join(pdf["block"]), _WIRE), max_bits)
        return pd.DataFrame({"a": a, "b": b})

    edges = _to_anchors(leads, limit).groupBy("grp", "part").applyInPandas(solve, "a long, b long")
    return components(edges.unionAll(stars.select(F.col("doc_id").alias("a"), F.col("item").alias("b")))).select(F.col("v").alias("doc_id"), F.col("root").alias("kept_id"))


def near_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs, with all their columns, without the documents listed by near_duplicates(); rows that repeat an id stay or go together.

    Rows with a null or empty text or without an id stay.
    """
    key = fresh_name(docs, "removed")
    gone = cut(near_duplicates(docs, max_bits).select(F.col("doc_id").alias(key)).distinct())
    if gone.count() * 8 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left_anti")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents: each document that goes, with the one kept of its group."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
