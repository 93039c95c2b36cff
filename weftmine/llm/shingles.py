"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240607)
_BYTES = _RANDOM.integers(1, 2**63, 256, np.uint64)
_PLACES = _RANDOM.integers(1, 2**63, 64, np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def stretches(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of stretches that begin at ``begins``, one stretch after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def mixed(h: np.ndarray) -> np.ndarray:
    """A fixed shuffle of all 64-bit numbers."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, ...]:
    """Of all texts' words (runs of bytes that aren't space): the texts with A-Z in lower case, where each word begins and ends, its hash, and the number of words before each text."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return data, none, none, none.view(np.uint64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    word = ~space[data]
    begin, end = word.copy(), word.copy()
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(begins):
        return data, begins, ends, begins.view(np.uint64), np.searchsorted(begins, offsets)
    # A byte and its place in the word give one of 2**64 numbers that follow no rule; a word's are added up.
    sizes = ends - begins
    first = np.cumsum(sizes) - sizes
    inside = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    hashes = mixed(np.add.reduceat(mixed(_BYTES[data[word]] + inside.astype(np.uint64) * _STEP), first))
    return data, begins, ends, hashes, np.searchsorted(begins, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each text its distinct k-word shingles, sorted; of a shorter one, its whole sequence of words as one shingle."""
    *_, hashes, starts = words(data, offsets)
    m = len(hashes) - k + 1
    grams = np.zeros(max(m, 0), np.uint64)
    for i in range(k if m > 0 else 0):
        grams += hashes[i : i + m] * _PLACES[i]
    grams = mixed(grams)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mixed((hashes[a:b] * _PLACES[32 : 32 + b - a]).sum(keepdims=True)))
        else:
            out.append(grams[:0])
    return out
