"""Word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd factors, one for each place in a run.
_TIMES = np.random.default_rng(20240229).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes(dict):
    """64-bit hashes of words, kept in a memo of bounded size."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


WORDS = WordHashes()


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX[0]
    values = (values ^ (values >> np.uint64(29))) * _MIX[1]
    return values ^ (values >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text, A-Z lower-cased; ASCII blanks part words."""
    words = text.lower().split()
    return np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` neighbours: a multilinear hash, then mixed."""
    n = max(0, len(hashes) - length + 1)
    total = np.full(n, length, dtype=np.uint64)
    for i in range(length):
        total += hashes[i : i + n] * _TIMES[i]
    return mix(total)


def shingle_set(words: np.ndarray, length: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``length`` words.

    A shorter text's whole sequence is its only shingle; without words there is none.
    """
    if not len(words):
        return words
    span = min(length, len(words))
    return np.unique(runs(words, span))


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
