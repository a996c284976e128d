"""Vectorised 64-bit hashing used by the passes over whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64) + np.uint64((seed * _BASE + 0x632BE59BD9B4E019) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of all windows of a byte string from one prefix sum modulo 2**64.

    Each byte stands for a random odd-bit number, so structured texts do not meet the
    weak spots of a modulus that is a power of two at the window lengths used here.
    """

    def __init__(self) -> None:
        self._bytes = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, 1 << 16)
            for name, base in (("_up", _BASE), ("_down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        terms = self._bytes[data]
        terms *= self._up[:n]
        np.cumsum(terms, out=sums[1:])
        return sums

    def windows(self, sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        found = sums[starts + length]
        found -= sums[starts]
        found *= self._down[starts]
        return mixed(found, length)


class Words(dict):
    """Eight hash bytes per word. Repeated words cost one dictionary lookup; the table is bounded."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = digest = xxhash.xxh3_64_digest(word)
        return digest

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the words of a text: A-Z lower-cased, cut at space and 0x09 to 0x0D."""
        return np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence if it is shorter; empty without words."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    total = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + words[i : n - size + 1 + i]
    return np.unique(mixed(total, size))
