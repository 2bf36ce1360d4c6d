"""Vectorised 64-bit hashes of words and word shingles; the same in every process."""

from __future__ import annotations

import numpy as np

SHINGLE = 5

_RNG = np.random.Generator(np.random.PCG64(20240101))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_TURN = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that are not ASCII white space.
NOT_WHITE = np.ones(256, dtype=bool)
NOT_WHITE[[0x20, *range(0x09, 0x0E)]] = False

_powers = np.empty(0, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(2 * n, _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def word_spans(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which member holds."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = member[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span; spans are in order, not empty and don't overlap."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    firsts = np.cumsum(sizes) - sizes
    within = np.arange(total) - np.repeat(firsts, sizes)
    taken = data[within + np.repeat(starts, sizes)]
    values = _BYTE[taken] * _powers_to(int(sizes.max()))[within]
    return mixed(np.add.reduceat(values, firsts) + sizes.astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the white-space separated words, A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    return span_hashes(data, *word_spans(data, NOT_WHITE))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles; of fewer words the whole sequence; none without words."""
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words
    if n < SHINGLE:
        return mixed((words * _TURN[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = words[: n - SHINGLE + 1] * _TURN[0]
    for j in range(1, SHINGLE):
        total = total + words[j : n - SHINGLE + 1 + j] * _TURN[j]
    return np.unique(mixed(total))
