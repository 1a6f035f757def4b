"""Byte-pair encoding by depth-first traversal of a prefix-sharing trie.

A vocabulary's merge order decides, for every string, one token that ends its
encoding; the encoding of the rest is that of the string without this token. So a
trie of the distinct words holds one state a node: the last token of the encoding
of the path to it. Depth-first traversal finds a node's state from its ancestors'
states, and words that share a prefix share that work.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, text_frame

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose encodings a worker keeps between batches; when there are more it begins anew (results are the same).
KEPT_WORDS = 600_000
#: Vocabulary files are broadcast up to this size.
MOST_BYTES = 32 << 20


class Vocabulary:
    """Byte strings by rank (a lower rank merges first). A token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                two = self._merged(token, below=rank)
                if len(two) == 2:
                    pair = (ranks[two[0]], ranks[two[1]])
                    self.halves[rank] = pair
                    self.joined[pair] = rank
        # A token that merging never makes (its own encoding is something else) can't end an encoding.
        self.usable = {b for b, i in ranks.items() if len(b) == 1 or i in self.halves}
        self.usable_rank = {b: ranks[b] for b in self.usable}
        ends: dict[int, set[int]] = {}
        for b in self.usable:
            ends.setdefault(b[-1], set()).add(len(b))
        # By last byte and depth (up to the longest token's), the lengths that a token can have, the longest first.
        self.lengths_by_depth = {c: [tuple(sorted((n for n in v if n <= d), reverse=True)) for d in range(self.longest + 1)] for c, v in ends.items()}
        self.seen: dict[int, bool] = {}

    def _merged(self, word: bytes, below: int | None = None) -> list[bytes]:
        """The textbook merge loop; with `below`, only merges of a lower rank happen."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best) and (below is None or r < below):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def holds(self, left: int, right: int) -> bool:
        """Whether encoding left's bytes followed by right's bytes gives exactly these two tokens.

        Undo the merges of both sides from the latest to the earliest. The border is crossed if at
        some moment the tokens at it form a pair that merges before the later of them was made.
        """
        key = left << 24 | right
        known = self.seen.get(key)
        if known is not None:
            return known
        a, b, bound, verdict = left, right, 1 << 60, True
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < bound:
                verdict = False
                break
            # The side made last is taken apart first; at equal ranks the left one was made first.
            ha, hb = self.halves.get(a), self.halves.get(b)
            if a > b:
                if ha is not None:
                    bound, a = a, ha[1]
                elif hb is not None:
                    bound, b = b + 1, hb[0]
                else:
                    break
            elif hb is not None:
                bound, b = b + 1, hb[0]
            elif ha is not None:
                bound, a = a, ha[1]
            else:
                break
        if len(self.seen) > 4_000_000:
            self.seen.clear()
        self.seen[key] = verdict
        return verdict

    def encode_words(self, distinct: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words by one depth-first traversal of their trie.

        The trie is in array form: the words in order, and of each the length of the path that it shares with
        the one before. Going through them in order is the traversal; what hangs on the shared path stays.
        """
        get, holds, lengths, longest = self.usable_rank.get, self.holds, self.lengths_by_depth, self.longest
        seen = self.seen
        last: list[int] = []  # last[d]: the token that ends the encoding of the path's first d+1 bytes
        size: list[int] = []
        out: dict[bytes, list[int]] = {}
        before = b""
        for w in sorted(distinct):
            m = min(len(w), len(before))
            differ = int.from_bytes(w[:m], "big") ^ int.from_bytes(before[:m], "big")
            shared = m - (differ.bit_length() + 7) // 8
            del last[shared:], size[shared:]
            for d in range(shared + 1, len(w) + 1):
                for n in lengths[w[d - 1]][d if d < longest else longest]:
                    token = get(w[d - n : d])
                    if token is None:
                        continue
                    if n < d:
                        left = last[d - n - 1]
                        fits = seen.get(left << 24 | token)
                        if not (holds(left, token) if fits is None else fits):
                            continue
                    last.append(token)
                    size.append(n)
                    break
                else:
                    raise ValueError("the vocabulary lacks single bytes")
            ids, k = [], len(w)
            while k:
                ids.append(last[k - 1])
                k -= size[k - 1]
            ids.reverse()
            out[w] = ids
            before = w
        return out


@lru_cache(maxsize=4)
def parsed(content: bytes) -> Vocabulary:
    return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())})


def load(path: str) -> Vocabulary:
    return parsed(content_of(path))


def content_of(path: str) -> bytes:
    """The vocabulary file, read by the driver; tasks get it by broadcast, so a path need not exist on executors."""
    with open(path, "rb") as f:
        content = f.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError(f"a vocabulary of more than {MOST_BYTES} bytes: {path}")
    return content


@lru_cache(maxsize=4)
def _kept_words(content: bytes) -> tuple[dict[str, bytes], set[str]]:
    """The encodings that this worker has made with a vocabulary, and the words that these don't decode to."""
    return {}, set()


def encode_texts(texts: list[str | None], content: bytes) -> list[tuple[np.ndarray, bool] | None]:
    """(token ids, whether they decode to the text) of each text; None for a null text, no ids for an empty one.

    No token crosses a word's border, so ids decode to the text if each distinct word's do and the words make up the text.
    """
    split = regex.compile(PATTERN)
    kept, lossy = _kept_words(content)
    if len(kept) > KEPT_WORDS:
        kept.clear()
        lossy.clear()
    pieces = [None if t is None else split.findall(t) for t in texts]
    new = {w for p in pieces if p for w in p} - kept.keys()
    if new:
        vocabulary = parsed(content)
        by_bytes = {w.encode("utf-8", "surrogatepass"): w for w in new}
        for b, ids in vocabulary.encode_words(list(by_bytes)).items():
            kept[by_bytes[b]] = np.array(ids, np.int32).tobytes()
            if b"".join(map(vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace") != by_bytes[b]:
                lossy.add(by_bytes[b])
    out: list[tuple[np.ndarray, bool] | None] = []
    for p, t in zip(pieces, texts):
        out.append(None if p is None else (np.frombuffer(b"".join(map(kept.__getitem__, p)), np.int32), "".join(p) == t and (not lossy or lossy.isdisjoint(p))))
    return out


def decode_ids(ids: list[int | None], vocabulary: Vocabulary) -> tuple[str | None, str | None]:
    """(text, None), or (None, what is wrong) if an id is null or outside the vocabulary. Bytes that aren't UTF-8 become U+FFFD."""
    parts = [vocabulary.bytes_of.get(i) for i in ids]
    if None in parts:
        at = parts.index(None)
        return None, f"no token {ids[at]} at {at}"
    return b"".join(parts).decode("utf-8", "replace"), None


def bpe_encode(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, tokens ARRAY<INT>, n_tokens, decodes): decodes tells whether decoding the ids gives the text back.

    A null text has null tokens, count and flag; an empty one has an empty array. Rows are kept as
    they are, repeated ones and those without an id too; very long texts are encoded whole; other columns are ignored. Needs no shuffle.
    """
    given = docs.sparkSession.sparkContext.broadcast(content_of(vocabulary))  # its size is checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            codes = encode_texts(texts, given.value)
            lengths = np.array([0 if c is None else len(c[0]) for c in codes], np.int64)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            flat = np.concatenate([c[0] for c in codes if c is not None] or [np.empty(0, np.int32)])
            absent = np.array([c is None for c in codes])
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(absent))
            same = [None if c is None else c[1] for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), tokens, pa.array(lengths, mask=absent), pa.array(same, pa.bool_())], ["doc_id", "tokens", "n_tokens", "decodes"])

    return text_frame(docs).mapInArrow(run, "doc_id long, tokens array<int>, n_tokens long, decodes boolean")


def bpe_decode(encoded: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, text, error) of (doc_id, tokens).

    Null tokens give a null text without an error; a null among the ids or one outside the vocabulary a null text and what is
    wrong. No ids give an empty text. Repeated rows are decoded each; other columns are ignored.
    """
    given = encoded.sparkSession.sparkContext.broadcast(content_of(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(None, None) if t is None else decode_ids(t, parsed(given.value)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], ["doc_id", "text", "error"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "doc_id long, text string, error string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bpe_encode() of all documents by the default vocabulary: a row each, null texts with nulls."""
    return bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
