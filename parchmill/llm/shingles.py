"""Word shingles of whole texts as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (public-domain splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word [^\\x20\\x09-\\x0D]+ in order, A-Z taken as a-z."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.uint64)
    edge = np.diff(np.concatenate(([True], _GAP[b], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _tables(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[b] * power[: len(b)], out=total[1:])
    return _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of `size` words, sorted; with fewer words the whole sequence is one; without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(size, len(w))
    n = len(w) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        total = _mix(total + w[j : j + n] * np.uint64(2 * j + 3))
    return np.unique(total)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())
