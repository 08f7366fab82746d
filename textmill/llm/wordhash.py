"""Words of texts as 64-bit hashes, in numpy, for operators on word chains and shingles."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np

WORD = re.compile(r"\w+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Odd multipliers, one for each place of a chain.
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3) % 2**64 | 1 for i in range(16)], np.uint64)


class _Known(dict):
    def __init__(self, marked: frozenset[str]):
        self.marked = marked

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") & ~1 | (word in self.marked)
        self[word] = h
        return h


class WordHasher:
    """Hashes of words; the lowest bit tells words of a given list. Remembered words are bounded."""

    def __init__(self, marked: frozenset[str] = frozenset(), most: int = 200_000):
        self.known, self.most = _Known(marked), most

    def __call__(self, text: str) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        words = WORD.findall(text.lower())
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the distinct n-word shingles, ascending; fewer words make one shingle, no word none."""
    if not len(h):
        return h
    n = min(n, len(h))
    acc = h[: len(h) - n + 1] * PLACES[0]
    for i in range(1, n):
        acc = acc + h[i : len(h) - n + 1 + i] * PLACES[i]
    return np.unique(mix(acc + np.uint64(n)))
