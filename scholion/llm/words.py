"""Hashes of words and of runs of words, as arrays, for operators that count or compare them."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
#: Word hashes that a task keeps at most, and the longest word that it keeps.
CACHED_WORDS, CACHED_BYTES = 250_000, 64
#: The odd factors of a word's place in a run, and those of a widely used 64-bit finaliser.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
FINAL = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``; different values stay different."""
    x = (x ^ x >> np.uint64(30)) * FINAL[0]
    x = (x ^ x >> np.uint64(27)) * FINAL[1]
    return x ^ x >> np.uint64(31)


class WordHashes(dict):
    """Word in bytes -> its 64-bit hash; frequent words are looked up, not hashed again. One for each task, so it ends with it."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < CACHED_WORDS and len(word) <= CACHED_BYTES:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A well mixed key for each run of ``n`` (1 to 4) neighbouring words; fewer words make no run."""
    count = max(0, len(hashes) - n + 1)
    total = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        total += hashes[k : k + count] * PLACES[k]
    return mix(total)
