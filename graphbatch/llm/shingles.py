"""Word shingles as 64-bit hashes, vectorised per text."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the hash that joins word hashes into a shingle.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of_text(text: str | None) -> list[bytes]:
    """Words of the UTF-8 text with A-Z lower-cased; ``bytes`` methods touch ASCII only, as is wanted."""
    return (text or "").encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, in order; a shorter text is one run of its own length."""
    k = min(k, len(hashes))
    if not k:
        return np.zeros(0, np.uint64)
    h = np.full(len(hashes) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h + hashes[j : len(hashes) - k + 1 + j]) * STEP
            h ^= h >> np.uint64(32)
        return _finish(h)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(windows(word_hashes(words_of_text(text)), k))
