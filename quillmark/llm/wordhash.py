"""Vectorised 64-bit hashes of the words and word shingles of many texts at a time."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers, the same on every machine."""
    return mix((np.arange(start + 1, start + n + 1, dtype=np.uint64)) * _STEP)


_POSITION = seeds(4096) | np.uint64(1)


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes: multilinear in its bytes, finalised with its length. Spans aren't empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int(lengths.max())
    table = _POSITION if longest <= len(_POSITION) else seeds(longest) | np.uint64(1)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    within = np.arange(total) - np.repeat(ends - lengths, lengths)
    at = within + np.repeat(starts, lengths)
    value = (data[at].astype(np.uint64) + np.uint64(1)) * table[within]
    return mix(np.add.reduceat(value, ends - lengths) + lengths.astype(np.uint64) * _STEP)


def words_of(texts: list[bytes], space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text); space[byte] tells the bytes that end words."""
    n = np.zeros(len(texts), np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = space[data]
    inside = ~gap
    starts = np.flatnonzero(inside & np.r_[True, gap[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64), n
    ends = np.flatnonzero(gap & np.r_[False, inside[:-1]])
    first = np.cumsum(sizes + 1) - sizes - 1
    n = np.diff(np.r_[np.searchsorted(starts, first), len(starts)])
    return hash_spans(data, starts, ends - starts), n


def shingles_of(words: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k-word shingles, number of them in each text); a text of 1 to k-1 words has one, of all its words."""
    c = seeds(k, 1 << 20) | np.uint64(1)
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), m)
    if not len(doc):
        return np.zeros(0, np.uint64), m
    first = np.cumsum(n) - n
    at = np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m) + first[doc]
    width = np.minimum(n[doc], k)
    padded = np.r_[words, np.zeros(k, np.uint64)]
    out = width.astype(np.uint64) * _STEP
    for j in range(k):
        out = out + np.where(j < width, padded[at + j], np.uint64(0)) * c[j]
    return mix(out), m
