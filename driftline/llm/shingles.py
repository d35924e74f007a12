"""Word shingles of texts as sets of 64-bit hashes, in arrays."""

from __future__ import annotations

import numpy as np
import xxhash

# Constants of a 64-bit mixing function.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words, A to Z lower-cased.

    A shorter text that has words is one run as a whole; one without has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(hashes) - words + 1
    if n < 1:
        n, words = 1, len(hashes)
    out = np.full(n, words, dtype=np.uint64)
    for i in range(words):
        out = mixed(out * STEP + hashes[i : i + n])
    return np.unique(out)
