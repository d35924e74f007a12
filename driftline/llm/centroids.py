"""Exact k-means with bit planes: a vector of 64 components is one word for each bit.

Vectors are packed once and written; every round reads the planes, takes exact distances by AND and
popcount against the planes of the centroids, and adds up each cluster's components task by task, so
that only ``k`` rows a task are shuffled, whatever a cluster's size. Centroids are whole numbers: the
driver holds ``k`` times 64 of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import planes
from driftline.session import cut_lineage

#: Components are held at this bound, so that a squared distance fits 63 bits.
BOUND = 2**27 - 1


class Clusters(NamedTuple):
    """Rows ``vec_id, cluster, distance``, and the final centroids by number."""

    rows: DataFrame
    centroids: list[list[int]]


def _packed(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, cells in planes.by_length(batch.column(1), scale, BOUND).values():
                bits = planes.bits_of(cells)
                words = np.ascontiguousarray(planes.sliced(cells, bits)[:, :, 0].T)
                squares = (cells * cells).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array([w.tobytes() for w in words], pa.binary()),
                     pa.array(squares, pa.int64())],
                    ["vec_id", "planes", "square"],
                )

    return run


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, planes by bit and row, and squares of the rows with as many planes."""
    words = batch.column("planes")
    sizes = np.asarray(pc.binary_length(words))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        flat = b"".join(words.take(pa.array(rows)).to_pylist())
        own = np.ascontiguousarray(np.frombuffer(flat, "<u8").reshape(len(rows), size // 8).T)
        yield batch.column("vec_id").take(pa.array(rows)), own, np.asarray(batch.column("square"))[rows]


def _nearest(own: np.ndarray, squares: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of every row; of ties the smaller number."""
    far = np.stack([
        squares - 2 * planes.products(own, c) + (c * c).sum() for c in np.array(centroids, dtype=np.int64)
    ])
    cluster = far.argmin(axis=0)
    return cluster, far[cluster, np.arange(len(cluster))]


def _summed(centroids: list[list[int]]):
    """For each cluster of a task: the sums of all components, then the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (planes.WORD + 1) for _ in centroids]
        for batch in batches:
            for _, own, squares in _groups(batch):
                cluster, _ = _nearest(own, squares, centroids)
                values = planes.joined(own)
                for c in np.unique(cluster):
                    mine = values[cluster == c]
                    added = [*mine.sum(axis=0).tolist(), len(mine)]
                    sums[c] = [a + b for a, b in zip(sums[c], added, strict=True)]
        kept = [c for c, s in enumerate(sums) if s[-1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept, pa.int32()), pa.array([sums[c] for c in kept], pa.list_(pa.decimal128(38, 0)))],
            ["cluster", "sums"],
        )

    return run


def _assigned(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own, squares in _groups(batch):
                cluster, distance = _nearest(own, squares, centroids)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                    ["vec_id", "cluster", "distance"],
                )

    return run


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024.0, seed: int = 3,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> Clusters:
    """Clusters of the vectors with exactly 64 components, none null or not finite.

    Components are ``floor(scale * x)``. Centroids start as the ``k`` vectors whose
    ``sha256("<seed>:<vec_id>")`` is smallest, rows without an id last and ties by the vector; there
    are fewer if there are fewer vectors. Each round assigns every vector to the nearest centroid
    (ties: the smaller number) and moves each centroid that has vectors to the exact floor of their
    mean. All other vectors take no part, other columns are left out. Rows that repeat an id or a
    vector count each; a null id stays null in the result. An empty table gives no rows and no
    centroids. Components beyond 2**27 stand for that bound.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v")).where(
        planes.whole("v") & (F.size("v") == planes.WORD)
    )
    table = cut_lineage(
        rows.mapInArrow(_packed(scale), f"vec_id {id_type}, planes binary, square long"), "centroid-planes"
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    start = planes.by_length(pa.array([r["v"] for r in first], pa.list_(pa.float64())), scale, BOUND)
    centroids = start[planes.WORD][1].tolist() if first else []
    if not centroids:
        return Clusters(spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long"), [])
    for _ in range(rounds):
        sums = table.mapInArrow(_summed(centroids), "cluster int, sums array<decimal(38,0)>")
        moved = (
            sums.select("cluster", F.posexplode("sums").alias("at", "part"))
            .groupBy("cluster", "at").agg(F.sum("part").alias("total")).collect()  # 65 rows for each centroid
        )
        totals = {(r["cluster"], r["at"]): int(r["total"]) for r in moved}
        centroids = [
            [totals[c, i] // totals[c, planes.WORD] for i in range(planes.WORD)] if (c, 0) in totals else old
            for c, old in enumerate(centroids)
        ]
    found = table.mapInArrow(_assigned(centroids), f"vec_id {id_type}, cluster int, distance long")
    return Clusters(cut_lineage(found, "centroid-rows"), centroids)


def with_digests(clusters: Clusters) -> DataFrame:
    """Rows with the inertia of their cluster and of all (null beyond a long), and the centroid's sha256."""
    kind = F.sum(F.col("distance").cast("decimal(38,0)"))
    totals = {r["cluster"]: int(r["d"]) for r in clusters.rows.groupBy("cluster").agg(kind.alias("d")).collect()}
    numbers = range(len(clusters.centroids))

    def as_long(value: int) -> int | None:
        return value if value < 2**63 else None

    def looked_up(values: list, kind: str) -> F.Column:
        array = F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array(F.lit(None).cast(kind))
        return F.get(array, F.col("cluster"))

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in clusters.centroids]
    return clusters.rows.select(
        "vec_id", "cluster", "distance",
        looked_up([as_long(totals.get(c, 0)) for c in numbers], "long").alias("cluster_inertia"),
        F.lit(as_long(sum(totals.values()))).cast("long").alias("inertia"),
        looked_up(digests, "string").alias("centroid_sha256"),
    )
