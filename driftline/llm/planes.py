"""Whole numbers as bit planes in 64-bit words, whose AND and popcount give exact products.

A plane holds one bit of many numbers. If ``x`` is the sum of ``2**i`` times its bits, then a sum of
products of two columns is the sum of ``2**(i + j)`` times the popcount of plane ``i`` of the one AND
plane ``j`` of the other: no product is formed, so nothing is rounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def whole(vector: str) -> Column:
    """Whether a vector is present and holds neither nulls nor values that aren't finite."""
    def hole(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return F.col(vector).isNotNull() & ~F.exists(vector, hole)


def by_length(lists: pa.Array, scale: float, bound: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and ``floor(scale * x)`` of whole vectors, by length; beyond ``bound`` they stay at it."""
    offsets = np.asarray(lists.offsets)
    values = np.asarray(lists.values.cast(pa.float64()))
    lengths = np.diff(offsets)
    found = {}
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        cells = values[offsets[rows][:, None] + np.arange(length)]
        with np.errstate(over="ignore"):
            found[int(length)] = rows, np.clip(np.floor(scale * cells), -bound, bound).astype(np.int64)
    return found


def bits_of(values: np.ndarray) -> int:
    """Bits that hold all values in two's complement."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    return max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1


def sliced(values: np.ndarray, bits: int) -> np.ndarray:
    """Planes of the rows of ``values``: words by bit, row and 64 columns, which are filled with zeros."""
    rows, columns = values.shape
    padded = np.zeros((rows, -(-columns // WORD) * WORD), dtype=np.int64)
    padded[:, :columns] = values
    planes = [
        np.packbits(((padded >> bit) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")
        for bit in range(bits)
    ]
    return np.stack(planes)


def weights(bits: int) -> np.ndarray:
    """What each plane of two's complement counts."""
    powers = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    powers[-1] = -powers[-1]
    return powers


def joined(planes: np.ndarray) -> np.ndarray:
    """The values, 64 to a row, of planes with one word for each row."""
    bits, rows = planes.shape
    values = np.zeros((rows, WORD), dtype=np.int64)
    for plane, weight in zip(planes, weights(bits), strict=True):
        ones = np.unpackbits(np.ascontiguousarray(plane).view(np.uint8).reshape(rows, 8), axis=1, bitorder="little")
        values += weight * ones
    return values


def products(planes: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact inner product of one vector of 64 components with each of the vectors in ``planes``."""
    bits = bits_of(vector)
    own = weights(len(planes))
    total = np.zeros(planes.shape[1], dtype=np.int64)
    for word, weight in zip(sliced(vector[None, :], bits)[:, 0, 0], weights(bits), strict=True):
        if word:
            total += weight * (own @ np.bitwise_count(planes & word).astype(np.int64))
    return total
