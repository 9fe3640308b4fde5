"""Words of texts and their hashes, by array operations over bytes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(97)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    """1, b, b^2, ... of 64-bit integers."""
    p = np.empty(n, dtype=np.uint64)
    p[0:1] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(_BASE, done, 1 << 64))
        more = min(done, n - done)
        p[done : done + more] = p[:more] * step
        done += more
    return p


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words, which are parted by bytes 0x20 and 0x09 to 0x0D."""
    if not data:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = np.concatenate([[False], ~_SPACE[np.frombuffer(data, dtype=np.uint8)], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


#: Elements that ``sums`` takes at once, which bounds its temporary arrays.
AT_ONCE = 1 << 19


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each sequence values[start:end]."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = ends - starts
    done = np.cumsum(size)
    if done[-1] > AT_ONCE and len(starts) > 1:
        cuts = np.unique(np.concatenate([[0], np.searchsorted(done, np.arange(AT_ONCE, done[-1], AT_ONCE), side="right"), [len(starts)]]))
        if len(cuts) == 2:  # one long sequence among short ones
            cuts = np.array([0, len(starts) // 2, len(starts)])
        return np.concatenate([sums(values, starts[a:b], ends[a:b]) for a, b in zip(cuts, cuts[1:])])
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    some = values[np.repeat(starts, size) + at] * _powers(int(size.max()))[at]
    total = np.add.reduceat(np.append(some, np.uint64(0)), np.cumsum(size) - size)
    total[size == 0] = 0
    return mix(total ^ (size.astype(np.uint64) * np.uint64(_BASE)))


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return sums(_BYTE[np.frombuffer(data, dtype=np.uint8)], starts, ends)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j, p in enumerate(_powers(width)):
        total += words[j : j + n] * p
    return mix(total)
