"""Word shingles of byte strings as 64-bit hashes, whole arrays at a time."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
#: one random number per byte value, the lower-case one for A-Z
BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
BYTE[65:91] = BYTE[97:123]
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
BASE = np.uint64(0xD1342543DE82EF95)
BACK = np.uint64(pow(int(BASE), -1, 2**64))
PLACE = _RNG.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_power = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n at least."""
    global _power
    if len(_power[0]) < n:
        n = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _power = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x)]) for x in (BASE, BACK))
    return _power


def words(text: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text (bytes): runs without blanks, A-Z as a-z."""
    blank = BLANK[text]
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True]))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = powers(len(text) + 1)
    total = np.r_[np.uint64(0), np.cumsum(BYTE[text] * up[: len(text)])]
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words; a shorter sequence is one shingle, no words are none."""
    w = words(text)
    if not len(w):
        return w
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h += w[j : len(w) - n + 1 + j] * PLACE[j]
    return np.unique(mixed(h))
