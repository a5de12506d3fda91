"""Word shingles of whole texts as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word (run without ASCII white space) of UTF-8 text, A-Z lower-cased."""
    return words_at(data)[0]


def words_at(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes(), and the byte at which each word starts."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ink = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(ink.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _to(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of each k words in a row; of all words as one where there are fewer; none without words."""
    words = word_hashes(data)
    if not len(words):
        return words
    size = min(k, len(words))
    found = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        found = mix(found * np.uint64(0x2545F4914F6CDD1D) + words[i : len(words) - size + 1 + i])
    return np.unique(mix(found + np.uint64(size)))
