"""Exact top-k search by inner product through global score histograms.

Vectors are packed into blocks, and blocks of queries meet blocks of candidates in a grid of cells
of bounded size. Each round scores everything, counts the scores of each query in bins, adds the
counts of all cells up, and narrows the query's interval to the bin that holds its k-th value,
until bins are one score wide. A last round keeps the scores above that value, and of the ties on
it those with the smallest ids. All tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import cut_and_count, cut_lineage

#: Queries in a block, candidates in a cell, candidates scored at once, bins of a histogram.
QUERIES, CELL, CHUNK, BINS = 2048, 8192, 512, 256
LIMIT = 2.0**61
STATE = "array<struct<place:int,low:long,size:long,need:long>>"


def _matrix(batch: pa.RecordBatch, column: int, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and scaled vectors by number of components; vectors that take no part are left out."""
    lists = batch.column(column)
    offsets = np.asarray(lists.offsets)
    flat = lists.values
    valid = np.asarray(lists.is_valid())
    bad = np.asarray(flat.is_null()).copy()
    values = np.asarray(flat.fill_null(0).cast(pa.float64()))
    bad |= ~np.isfinite(values)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    valid &= wrong[offsets[1:]] == wrong[offsets[:-1]]
    with np.errstate(over="ignore"):
        values = np.floor(scale * values)
    lengths = np.diff(offsets)
    out = {}
    for dim in np.unique(lengths[valid]):
        rows = np.flatnonzero(valid & (lengths == dim))
        out[int(dim)] = rows, values[offsets[rows][:, None] + np.arange(dim)]
    return out


def _packed(rows: DataFrame, most: int, scale: float) -> DataFrame:
    """Blocks of at most ``most`` vectors of one dimension; ``block`` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([x for x, _ in held[dim]])
            cells = np.concatenate([x for _, x in held[dim]])
            held[dim] = [(ids[most:], cells[most:])] if len(ids) > most else []
            ids, cells = ids[:most], cells[:most]
            with np.errstate(over="ignore"):
                norm = float(np.minimum(np.sqrt((cells * cells).sum(axis=1).max(initial=0.0)), LIMIT))
            arrays = [[dim], [len(ids)], [ids.astype("<i8").tobytes()], [cells.astype("<f8").tobytes()], [norm]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], ["dim", "n", "ids", "cells", "norm"]
            )

        for batch in batches:
            ids = np.asarray(batch.column(0).cast(pa.int64()))
            for dim, (at, cells) in _matrix(batch, 1, scale).items():
                held.setdefault(dim, []).append((ids[at], cells))
                while sum(len(x) for x, _ in held[dim]) >= most:
                    yield block(dim)
        for dim in list(held):
            if held[dim]:
                yield block(dim)

    packed = rows.mapInArrow(run, "dim int, n int, ids binary, cells binary, norm double")
    return packed.select("dim", F.monotonically_increasing_id().alias("block"), "n", "ids", "cells", "norm")


class Cell:
    """One block of queries against the candidate blocks of a cell."""

    def __init__(self, queries: pa.Table, candidates: pa.Table):
        row = queries.slice(0, 1).to_pylist()[0]
        self.block, self.ids = row["q_block"], np.frombuffer(row["ids"], "<i8")
        self.vectors = np.frombuffer(row["cells"], "<f8").reshape(row["n"], row["dim"])
        state = {s["place"]: s for s in row["state"]}
        at = range(row["n"])
        # A query that has met no candidate in an earlier round has no state and needs nothing.
        self.low = np.array([state[i]["low"] if i in state else 0 for i in at], dtype=np.int64)
        self.size = np.array([state[i]["size"] if i in state else 0 for i in at], dtype=np.int64)
        self.need = np.array([state[i]["need"] if i in state else 0 for i in at], dtype=np.int64)
        self.candidates = candidates

    def scores(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidate ids, integer scores less each query's low, and which pairs count."""
        for ids, cells in zip(self.candidates["ids"], self.candidates["cells"], strict=True):
            ids = np.frombuffer(ids.as_py(), "<i8")
            cells = np.frombuffer(cells.as_py(), "<f8").reshape(len(ids), self.vectors.shape[1])
            for i in range(0, len(ids), CHUNK):
                own = ids[i : i + CHUNK]
                with np.errstate(over="ignore", invalid="ignore"):
                    found = np.clip(np.nan_to_num(self.vectors @ cells[i : i + CHUNK].T), -LIMIT, LIMIT)
                yield own, found.astype(np.int64), self.ids[:, None] != own


def _histograms(cell: Cell) -> pa.Table:
    """Counts by query and bin, from the highest bin until the cell alone has what is needed.

    Lower bins can't hold the k-th value of all, as this cell's k-th is higher.
    """
    n = len(cell.ids)
    width = np.maximum(1, -(-cell.size // BINS))
    counts = np.zeros(n * BINS, dtype=np.int64)
    for _, scores, others in cell.scores():
        above = scores - cell.low[:, None]
        at, column = np.nonzero((above >= 0) & (above < cell.size[:, None]) & others)
        counts += np.bincount(at * BINS + above[at, column] // width[at], minlength=n * BINS)
    counts = counts.reshape(n, BINS)
    higher = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    at, bins = np.nonzero((counts > 0) & (higher < cell.need[:, None]))
    return pa.table({
        "block": pa.array(np.full(len(at), cell.block), pa.int64()), "place": pa.array(at, pa.int32()),
        "bin": pa.array(bins, pa.int32()), "count": pa.array(counts[at, bins], pa.int64()),
        "low": pa.array(cell.low[at], pa.int64()), "width": pa.array(width[at], pa.int64()),
        "need": pa.array(cell.need[at], pa.int64()),
    })


def _found(cell: Cell) -> pa.Table:
    """Scores above each query's k-th value, and the ties on it with the smallest ids."""
    at_all, id_all, score_all = [], [], []
    ties: dict[int, np.ndarray] = {}
    for ids, scores, others in cell.scores():
        others &= (scores >= cell.low[:, None]) & (cell.size > 0)[:, None]
        at, column = np.nonzero(others & (scores > cell.low[:, None]))
        at_all.append(at)
        id_all.append(ids[column])
        score_all.append(scores[at, column])
        at, column = np.nonzero(others & (scores == cell.low[:, None]))
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        for start, stop in zip(starts, np.append(starts, len(at))[1:], strict=True):
            q = at[start]
            tied = np.concatenate([ties.get(q, ids[:0]), ids[column[start:stop]]])
            ties[q] = np.sort(tied)[: cell.need[q]]
    for q, tied in ties.items():
        at_all.append(np.full(len(tied), q))
        id_all.append(tied)
        score_all.append(np.full(len(tied), cell.low[q]))
    at = np.concatenate([np.zeros(0, np.int64), *at_all])
    return pa.table({
        "block": pa.array(np.full(len(at), cell.block), pa.int64()), "place": pa.array(at, pa.int32()),
        "query_id": pa.array(cell.ids[at], pa.int64()),
        "vec_id": pa.array(np.concatenate([cell.ids[:0], *id_all]), pa.int64()),
        "score": pa.array(np.concatenate([cell.low[:0], *score_all]), pa.int64()),
    })


def _over_cells(queries: DataFrame, candidates: DataFrame, state: DataFrame, work, schema: str) -> DataFrame:
    """Apply ``work`` to every cell: a query block and a bounded group of candidate blocks."""
    # Each query block goes to every group of its dimension, each group to every query block.
    # So a cell always has both sides.
    groups = candidates.select("dim", "group").distinct().select(*[F.col(c).alias(c) for c in ("dim", "group")])
    blocks = queries.select("dim", F.col("block").alias("q_block"))
    left = queries.join(state, "block").withColumnRenamed("block", "q_block").join(groups, "dim")
    blocks = blocks.join(state.select(F.col("block").alias("q_block")), "q_block")
    right = candidates.join(blocks.select(F.col("dim").alias("dim"), "q_block"), "dim")
    keys = ["dim", "group", "q_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda q, c: work(Cell(q, c)), schema
    )


def _start(queries: DataFrame, norms: DataFrame, k: int) -> DataFrame:
    """Intervals that hold every score, by the norms of a query and of the longest candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["cells"], "<f8").reshape(row["n"], row["dim"])
                with np.errstate(over="ignore"):
                    most = np.minimum(np.sqrt((q * q).sum(axis=1)) * row["norm"] * (1 + 1e-9) + 2, LIMIT)
                state = [
                    {"place": i, "low": -int(b), "size": 2 * int(b) + 1, "need": k} for i, b in enumerate(most.tolist())
                ]
                kind = pa.list_(pa.struct([("place", pa.int32()), *[(c, pa.int64()) for c in ("low", "size", "need")]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64()), pa.array([state], kind)], ["block", "state"]
                )

    return queries.drop("norm").join(norms, "dim").select("block", "dim", "n", "cells", "norm").mapInArrow(
        run, f"block long, state {STATE}"
    )


def _narrowed(counts: DataFrame) -> DataFrame:
    """The bin that holds each query's k-th value; the lowest one if there are fewer values."""
    keys = ["block", "place"]
    summed = counts.groupBy(*keys, "bin", "low", "width", "need").agg(F.sum("count").alias("count"))
    down = Window.partitionBy(*keys).orderBy(F.desc("bin"))  # at most BINS rows
    chosen = (
        summed.withColumn("upto", F.sum("count").over(down))
        .withColumn("higher", F.col("upto") - F.col("count"))
        .where(F.col("higher") < F.col("need"))
        .groupBy(*keys)
        .agg(F.min_by(F.struct("bin", "low", "width", "need", "higher"), "bin").alias("last"))
    )
    return chosen.groupBy("block").agg(  # at most QUERIES rows
        F.collect_list(F.struct(
            "place", (F.col("last.low") + F.col("last.bin") * F.col("last.width")).alias("low"),
            F.col("last.width").alias("size"), (F.col("last.need") - F.col("last.higher")).alias("need"),
        )).alias("state")
    )


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """The ``k`` highest inner products of each row whose id is divisible by ``every``.

    Components are ``floor(scale * x)``. Returns ``query_id long, rank int, vec_id long, score
    long``, ties by the smaller vec_id; all candidates if there are fewer than ``k``. Rows with a
    null id or vector, or a component that is null or not finite, take no part. Vectors meet those
    with as many components only, and empty vectors score 0 with each other. A row is no candidate
    of a query with its own id, so rows that repeat an id are not found by it; a query that
    is repeated gets its rows once, from the vector that is least in its bytes. Scores are exact
    up to 2**53 and are cut at 2**61. Other columns are left out.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v")).where(
        "id IS NOT NULL AND v IS NOT NULL"
    )
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked, n_asked = cut_and_count(asked.select("id", "v"), "topk-asked")
    dealt = asked.repartition(max(1, -(-n_asked // QUERIES)))
    queries = cut_lineage(_packed(dealt, QUERIES, scale), "topk-queries")
    packed = cut_lineage(_packed(rows, CELL, scale), "topk-candidates")
    total = packed.agg(F.sum("n")).first()[0] or 0
    n_groups = max(1, -(-total // CELL))
    candidates = packed.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(n_groups)))
    norms = candidates.groupBy("dim").agg(F.max("norm").alias("norm"))
    state, size = cut_lineage(_start(queries, norms, k), "topk-state"), None
    candidates, queries = candidates.drop("norm"), queries.drop("norm")
    while (size := state.select(F.explode("state.size").alias("s")).agg(F.max("s")).first()[0]) and size > 1:
        counts = _over_cells(
            queries, candidates, state, _histograms,
            "block long, place int, bin int, count long, low long, width long, need long",
        )
        state = cut_lineage(_narrowed(counts), "topk-state")
    found = _over_cells(
        queries, candidates, state, _found, "block long, place int, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
