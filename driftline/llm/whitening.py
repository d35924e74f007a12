"""Whitening of embeddings from exact, bit-sliced cross-products.

Each different vector of whole numbers counts once. Tasks pack bit planes of every dimension across
rows into words, shifted by the smallest value of the block, and weighted AND-popcounts give sums of
products that are added up as whole numbers. The covariance is centred in whole numbers as well and
only then becomes doubles, so that a large common offset costs no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import planes
from driftline.session import cut_lineage

#: Components are held at this bound; rows of a block of planes; shifts that one 64-bit sum holds.
BOUND, BLOCK, LIMB = 2**52, 16384, 32
#: Eigenvalues below this part of the trace count as none.
FLAT = 1e-13


class Model(NamedTuple):
    """Whole-number sums of the fit list, and its leading components as rows of ``basis``."""

    n: int
    sums: list[int]
    values: np.ndarray
    basis: np.ndarray
    trace: float


def _coded(scale: float):
    """Vectors as bytes, by the narrowest of three widths, so that equal vectors have equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, (_, cells) in planes.by_length(batch.column(0), scale, BOUND).items():
                widest = np.abs(cells).max(axis=1, initial=0)
                for kind, low, high in (("<i2", -1, 2**15 - 1), ("<i4", 2**15 - 1, 2**31 - 1), ("<i8", 2**31 - 1, 2**62)):
                    own = np.ascontiguousarray(cells[(widest > low) & (widest <= high)].astype(kind))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), length), pa.int32()),
                         pa.array([row.tobytes() for row in own], pa.binary())], ["dim", "code"],
                    )

    return run


def _decoded(codes: pa.Array, dim: int) -> Iterator[np.ndarray]:
    sizes = np.asarray(pc.binary_length(codes))
    for size in np.unique(sizes):
        own = codes.take(pa.array(np.flatnonzero(sizes == size))).to_pylist()
        yield np.frombuffer(b"".join(own), f"<i{size // dim}").reshape(len(own), dim).astype(np.int64)


def crossed(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums, and sums of products of all pairs of columns, as Python numbers."""
    n, dim = cells.shape
    low = cells.min(axis=0)
    shifted = cells - low
    bits = max(1, int(shifted.max()).bit_length())
    words = planes.sliced(np.ascontiguousarray(shifted.T), bits)  # bit, dimension, word
    ones = np.bitwise_count(words).sum(axis=2, dtype=np.int64).astype(object)
    sums = sum((count << bit for bit, count in enumerate(ones)), np.zeros(dim, dtype=object))
    limbs = np.zeros((2 * (bits - 1) // LIMB + 1, dim, dim), dtype=np.int64)
    for i in range(bits):
        for d in range(dim):
            if words[i, d].any():
                counts = np.bitwise_count(words[i, d] & words[:, d:]).sum(axis=2, dtype=np.int64)
                for j in range(bits):
                    limbs[(i + j) // LIMB, d, d:] += counts[j] << ((i + j) % LIMB)
    total = sum((limb.astype(object) << (LIMB * at) for at, limb in enumerate(limbs)), np.zeros((dim, dim), dtype=object))
    upper = np.triu(total) + np.triu(total, 1).T
    low = low.astype(object)
    return sums + n * low, upper + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


def _totals(dim: int):
    """One row for each task: the number of vectors, the sums and the upper half of the products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        for batch in batches:
            for cells in _decoded(batch.column(0), dim):
                for at in range(0, len(cells), BLOCK):
                    block = cells[at : at + BLOCK]
                    own_sums, own_products = crossed(block)
                    n, sums, products = n + len(block), sums + own_sums, products + own_products
        if n:
            flat = [n, *sums.tolist(), *products[np.triu_indices(dim)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.decimal128(38, 0)))], ["parts"])

    return run


def _added(parts: DataFrame, kind: type) -> list:
    """Sums of arrays by position; as many rows as an array is long reach the driver."""
    rows = parts.select(F.posexplode("parts").alias("at", "part")).groupBy("at").agg(F.sum("part").alias("total"))
    return [kind(r["total"]) for r in sorted(rows.collect())]


def model_of(n: int, sums: list[int], upper: list[int], components: int) -> Model:
    """Leading components of the covariance; the entry of largest size in each is positive."""
    dim = len(sums)
    covariance = np.zeros((dim, dim))
    for d, e, product in zip(*np.triu_indices(dim), upper, strict=True):
        covariance[d, e] = covariance[e, d] = (n * product - sums[d] * sums[e]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    basis = vectors[:, order].T
    largest = basis[np.arange(len(basis)), np.abs(basis).argmax(axis=1)]
    return Model(n, sums, values[order], basis * np.sign(largest)[:, None], float(np.trace(covariance)))


def _centred(cells: np.ndarray, model: Model) -> np.ndarray:
    """``n`` times each component less its sum, as exact whole numbers."""
    furthest = model.n * int(np.abs(cells).max(initial=0)) + max(map(abs, model.sums))
    kind = np.int64 if furthest < 2**62 else object
    return cells.astype(kind) * model.n - np.array(model.sums, dtype=kind)


def _projected(centred: np.ndarray, model: Model) -> np.ndarray:
    flat = model.values <= FLAT * model.trace
    scale = np.sqrt(np.where(flat, 1.0, model.values))
    found = (centred / model.n).astype(float) @ model.basis.T / scale
    found[:, flat] = np.nan
    return found


def _deviations(centred: np.ndarray) -> pa.Array:
    if centred.shape[1] * int(np.abs(centred).max(initial=0)) ** 2 < 2**63:
        return pa.array((centred * centred).sum(axis=1).astype(np.int64)).cast(pa.decimal128(38, 0))
    centred = centred.astype(object)
    return pa.array((centred * centred).sum(axis=1).tolist(), pa.decimal128(38, 0))


def _whitened(model: Model, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, cells in planes.by_length(batch.column(1), scale, BOUND).values():
                centred = _centred(cells, model)
                found = pa.array(_projected(centred, model).ravel(), pa.float64(), from_pandas=True)
                count = len(model.values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), _deviations(centred),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * count, pa.int32()), found)],
                    ["vec_id", "deviation", "whitened"],
                )

    return run


def _moments(model: Model):
    """Sums, and sums of products, of the whitened fit list; one row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(model.values)
        sums, products = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            for cells in _decoded(batch.column(0), len(model.sums)):
                found = np.nan_to_num(_projected(_centred(cells, model), model))
                sums += found.sum(axis=0)
                products += found.T @ found
        flat = [*sums.tolist(), *products.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], ["parts"])

    return run


def _identity_error(fit: DataFrame, model: Model) -> float | None:
    """The largest entry by which the whitened fit list's covariance differs from the identity."""
    live = model.values > FLAT * model.trace
    if not live.any():
        return None
    count = len(model.values)
    flat = np.array(_added(fit.select("code").mapInArrow(_moments(model), "parts array<double>"), float)) / model.n
    mean, product = flat[:count], flat[count:].reshape(count, count)
    return float(np.abs(product - np.outer(mean, mean) - np.eye(count))[np.ix_(live, live)].max())


def whiten(
    vectors: DataFrame, components: int = 16, scale: float = 64.0,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """Every vector on the unit-variance principal components of the different vectors.

    Entries become ``floor(scale * c)``; an offset that all entries share would cancel in every result,
    exactly, and so is never added. Vectors that are null, empty, or hold a null or a
    value that isn't finite take no part, nor do vectors of another length than the one that most
    different vectors have (of equally frequent ones the shorter). Rows that repeat an id or a vector
    each give rows; the fit counts each vector once; other columns are left out. Returns
    ``vec_id, component, n, deviation, whitened, explained, identity_error``, components from 1 by
    falling variance, ``deviation`` as ``decimal(38,0)``. Components without variance give a null
    ``whitened``; if there is none at all (one different vector), ``explained`` and
    ``identity_error`` are null too. An empty table gives no rows. Entries beyond 2**52 stand for
    that bound. The driver holds sums of all pairs of dimensions.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v")).where(
        planes.whole("v") & (F.size("v") > 0)
    )
    fit = cut_lineage(rows.select("v").mapInArrow(_coded(scale), "dim int, code binary").distinct(), "whiten-fit")
    lengths = fit.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame(
            [], f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, "
            "explained double, identity_error double",
        )
    dim = lengths[0]["dim"]
    fit = fit.where(F.col("dim") == dim)
    n, *totals = _added(fit.select("code").mapInArrow(_totals(dim), "parts array<decimal(38,0)>"), int)
    model = model_of(n, totals[:dim], totals[dim:], components)
    error = _identity_error(fit, model)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in np.maximum(model.values, 0.0)]
    found = rows.where(F.size("v") == dim).mapInArrow(
        _whitened(model, scale), f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>"
    )
    shares = F.array(*[F.lit(e).cast("double") for e in explained])
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
