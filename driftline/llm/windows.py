"""Windows of bytes, grouped by the smallest hash of the grams inside them."""

from __future__ import annotations

import numpy as np

from driftline.llm.shingles import mixed

GRAM = 48
BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 16


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = _powers(BLOCK + GRAM)
INVERSES = None


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes that begin at each place."""
    n = len(data) - gram + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for i in range(0, n, BLOCK):
        part = data[i : min(len(data), i + BLOCK + gram - 1)].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * POWERS[: len(part)])])
        here = sums[gram:] - sums[:-gram]
        # Bring every gram to the same power, which is quicker than dividing by its own.
        out[i : i + len(here)] = here * POWERS[: len(here)][::-1] * (POWERS[BLOCK - len(here)] if len(here) < BLOCK else np.uint64(1))
    return mixed(out)


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, from running minima of blocks."""
    n = len(hashes)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = hashes
    grid = padded.reshape(blocks, width)
    down = np.minimum.accumulate(grid, axis=1).ravel()
    up = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[: n - width + 1], down[width - 1 : n])
