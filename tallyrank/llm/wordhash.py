"""64-bit hashes of all words of a text at once, in numpy.

A word's hash is a polynomial of its bytes modulo 2^64, taken as a difference
of prefix sums and moved to the origin by the base's inverse, then mixed; the
hash of a run of words is made from word hashes in the same way.
"""

from __future__ import annotations

import numpy as np

_BASE, _RUN = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, extended as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """``gap``: 256 flags, true for bytes that separate words; A-Z count as a-z."""

    def __init__(self, gap: np.ndarray):
        self.gap, self.bytes, self.runs = gap, _Powers(_BASE), _Powers(_RUN)
        self.lower = np.arange(256, dtype=np.uint64)
        self.lower[65:91] += 32

    def words(self, text: str | None) -> np.ndarray:
        """The hash of every word, in order."""
        b = np.frombuffer(text.encode("utf-8"), np.uint8) if text else np.zeros(0, np.uint8)
        edge = np.diff(np.concatenate(([1], self.gap[b].astype(np.int8), [1])))
        lo, hi = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(lo):
            return np.zeros(0, np.uint64)
        up, down = self.bytes.get(len(b))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((self.lower[b] + np.uint64(1)) * up, dtype=np.uint64)))
        return mix((sums[hi] - sums[lo]) * down[lo])

    def heads(self, text: str | None, n: int) -> np.ndarray:
        """The hash of the first ``n`` bytes of every longer word."""
        b = np.frombuffer(text.encode("utf-8"), np.uint8) if text else np.zeros(0, np.uint8)
        edge = np.diff(np.concatenate(([1], self.gap[b].astype(np.int8), [1])))
        lo, hi = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        lo = lo[hi - lo > n]
        if not len(lo):
            return np.zeros(0, np.uint64)
        up, down = self.bytes.get(len(b))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((self.lower[b] + np.uint64(1)) * up, dtype=np.uint64)))
        return mix(mix((sums[lo + n] - sums[lo]) * down[lo]) + np.uint64(n))

    def grams(self, words: np.ndarray, n: int) -> np.ndarray:
        """The hash of every run of ``n`` consecutive words."""
        if len(words) < n:
            return np.zeros(0, np.uint64)
        up, down = self.runs.get(len(words))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(words * up, dtype=np.uint64)))
        return mix((sums[n:] - sums[:-n]) * down[:len(words) - n + 1])


def white_space() -> np.ndarray:
    gap = np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    return gap


def no_letter() -> np.ndarray:
    """ASCII characters that are no letters; characters beyond ASCII count as letters."""
    return np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
