"""Vectorised word splitting and rolling hashes over a concatenation of texts.

A text's words are its maximal runs of bytes other than ASCII white space. With
``fold`` the text is lower-cased first and ASCII punctuation also separates words.
Hashes are polynomials modulo 2**64 with an odd base, so that the hash of any run
is a difference of two prefix sums times an inverse power.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_TABLE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = bytes(0x20 if i in (9, 10, 11, 12, 13, 0x20) else i for i in range(256))
_FOLD = bytes(i if i >= 0x80 or chr(i).isalnum() else 0x20 for i in range(256))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the worker's life and grown when needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16 if have is None else 2 * len(have))
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finish: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """hash: of each word; length: in bytes; doc: its text's index; first: index of each text's first word, and one more."""

    hash: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def words(texts: list[str | None], fold: bool = False) -> Words:
    if fold:
        raw = [(t.lower().encode("utf-8", "surrogatepass").translate(_FOLD) if t else b"") for t in texts]
    else:
        raw = [(t.encode("utf-8", "surrogatepass").translate(_SPACE) if t else b"") for t in texts]
    joined = b" " + b" ".join(raw) + b" "
    buf = np.frombuffer(joined, np.uint8)
    begin = np.cumsum(np.array([1] + [len(r) + 1 for r in raw], np.int64))
    solid = buf != 0x20
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * powers(_BYTE_BASE, len(buf)), out=sums[1:])
    h = mix((sums[end] - sums[start]) * powers(inverse(_BYTE_BASE), len(buf))[start])
    first = np.searchsorted(start, begin)
    first[-1] = len(start)
    return Words(h, (end - start).astype(np.int32), np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first)), first)


def run_sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which run_hash() takes the hash of any run of h."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_WORD_BASE, len(h)), out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Hash of the runs of `size` items beginning at `start`."""
    n = len(sums)
    return mix((sums[start + size] - sums[start]) * powers(inverse(_WORD_BASE), n)[start])
