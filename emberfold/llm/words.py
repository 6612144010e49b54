"""Hashes of words and of runs of words, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

CACHED_WORDS = 300_000
LONGEST = 16
POWERS = np.random.default_rng(7919).integers(0, 1 << 62, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """Hashes of words, remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def ngrams(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words, in order."""
    codes = np.full(max(len(hashes) - width + 1, 0), np.uint64(width))
    for k in range(width):
        part = hashes[k : len(codes) + k]
        codes = codes * POWERS[k] + (part ^ (part >> np.uint64(29)))
    return codes ^ (codes >> np.uint64(32))
