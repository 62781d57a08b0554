"""Word and shingle digests of texts in numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _BASE)]).astype(np.uint64))


def lowered(text: str | None) -> np.ndarray:
    """UTF-8 bytes of ``text`` with A-Z lower-cased; null is empty."""
    return _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    inside = np.concatenate([[False], ~_IS_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    letters = data[~_IS_SPACE[data]]
    sums = np.add.reduceat(_BYTE[letters] * powers(int(sizes.max()))[place], first)
    return mixed(sums + sizes.astype(np.uint64) * _PLACE[SHINGLE])


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct digests of the shingles of ``size`` words; of a shorter text, one digest of all its words."""
    data = lowered(text)
    words = word_digests(data, *word_bounds(data))
    if not len(words):
        return words
    if len(words) < size:
        return mixed((words * _PLACE[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total += words[k : k + len(total)] * _PLACE[k]
    return np.unique(mixed(total))
