"""Whitening and clustering against plain big-number arithmetic."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import centroids, planes, whitening
from driftline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, dim int, planes string, code binary"


def table(spark, vectors):
    rows = [(i, v, 0, 1, "x", b"y") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def whole(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(64)]) for i in range(150)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(40)]  # one crowd of equal vectors
    rows += [(7, list(rows[9][1])), (None, list(rows[3][1])), (None, [0.5] * 64), (2001, [-3.0] * 64)]
    rows += [(3000, None), (3001, []), (3002, [0.1] * 63), (3003, [0.1] * 63 + [None])]
    rows += [(3004, [0.1] * 63 + [math.nan]), (3005, [math.inf] + [0.1] * 63), (3006, [0.25] * 65)]
    return rows


@pytest.mark.parametrize("spread", [0, 1, 200, 2**26])
def test_planes_give_exact_products(spread):
    rnd = np.random.default_rng(spread)
    values = rnd.integers(-spread, spread + 1, (40, 64))
    bits = planes.bits_of(values)
    words = planes.sliced(values, bits)[:, :, 0]
    assert (planes.joined(words) == values).all()
    for vector in values[:5]:
        assert planes.products(words, vector).tolist() == [
            sum(a * b for a, b in zip(vector.tolist(), row, strict=True)) for row in values.tolist()
        ]


@pytest.mark.parametrize(("spread", "rows"), [(1, 1), (3, 64), (100, 65), (2**20, 130), (2**51, 70)])
def test_cross_products_are_exact(spread, rows):
    rnd = random.Random(rows)
    values = [[rnd.randint(-spread, spread) + 10**6 for _ in range(5)] for _ in range(rows)]
    sums, products = whitening.crossed(np.array(values))
    columns = list(zip(*values, strict=True))
    assert sums.tolist() == [sum(c) for c in columns]
    assert products.tolist() == [[sum(a * b for a, b in zip(c, d, strict=True)) for d in columns] for c in columns]


def plain_clusters(vectors, k, rounds, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v], v) for i, v in vectors if whole(v) and len(v) == 64]

    def rank(row):
        digest = "" if row[0] is None else hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest()
        return row[0] is None, digest, row[2]

    middle = [x for _, x, _ in sorted(kept, key=rank)[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, x, _ in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        middle = [
            [sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else old
            for n, old in enumerate(middle)
        ]
    return sorted((str(i), nearest(x)[1], nearest(x)[0]) for i, x, _ in kept), middle


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (3, 0), (500, 2)])
def test_clusters(spark, vectors, k, rounds):
    found = centroids.cluster(table(spark, vectors), k=k, rounds=rounds)
    expected, middle = plain_clusters(vectors, k, rounds)
    assert found.centroids == middle
    rows = centroids.with_digests(found).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in rows) == expected
    total = sum(d for _, _, d in expected)
    for r in rows:
        assert r.inertia == total
        assert r.cluster_inertia == sum(d for _, c, d in expected if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()


def test_far_vectors_stay_at_the_bound(spark):
    far = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)]
    found = centroids.cluster(table(spark, far), k=3, rounds=1)
    assert sorted(r.distance for r in found.rows.collect()) == [0, 0, 0]
    assert max(map(max, found.centroids)) == centroids.BOUND


def plain_whitening(vectors, components):
    kept = [(i, [math.floor(64 * x) + 10**6 for x in v]) for i, v in vectors if whole(v) and len(v) == 64]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[Fraction(n * a - s, n) for a, s in zip(x, sums, strict=True)] for x in fit]
    columns = list(zip(*centred, strict=True))
    covariance = [[float(sum(a * b for a, b in zip(c, d, strict=True)) / n) for d in columns] for c in columns]
    values, basis = np.linalg.eigh(np.array(covariance))
    order = np.argsort(-values)[:components]
    whitened, deviation = {}, {}
    for i, x in kept:
        own = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        whitened.setdefault(i, []).append(own @ basis[:, order] / np.sqrt(values[order]))
        deviation.setdefault(i, []).append(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
    return n, values[order] / np.trace(np.array(covariance)), whitened, deviation


def test_whitening(spark, vectors):
    n, explained, whitened, deviation = plain_whitening(vectors, 16)
    rows = whitening.whiten(table(spark, vectors)).collect()
    assert {r.n for r in rows} == {n}
    assert max(r.identity_error for r in rows) < 1e-9
    by_component = {}
    for r in rows:
        assert int(r.deviation) in deviation[r.vec_id]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        if r.vec_id is not None and len(whitened[r.vec_id]) == 1:
            by_component.setdefault(r.component, []).append((r.whitened, whitened[r.vec_id][0][r.component - 1]))
    assert set(by_component) == set(range(1, 17))
    for pairs in by_component.values():
        mine, plain = np.array(pairs).T
        sign = np.sign(mine @ plain)  # one for all rows
        assert np.abs(mine - sign * plain).max() < 1e-8
    assert len(rows) == 16 * sum(map(len, whitened.values()))


def test_whitening_counts_a_crowd_once(spark, vectors):
    crowd = vectors + [(9000 + i, list(vectors[0][1])) for i in range(300)]
    alone, more = (
        whitening.whiten(table(spark, v)).where("vec_id = 1").orderBy("component").collect() for v in (vectors, crowd)
    )
    assert [(r.n, r.deviation, r.whitened) for r in alone] == [(r.n, r.deviation, r.whitened) for r in more]


def test_whitening_without_variance(spark):
    rows = whitening.whiten(table(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in rows] == [(1, 0, None, None, None)] * 4
    line = whitening.whiten(table(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).orderBy("vec_id", "component").collect()
    assert [(r.component, r.whitened) for r in line] == [(1, -1.0), (2, None), (1, 1.0), (2, None)]
    assert line[0].identity_error == 0.0 and line[0].explained == 1.0


def test_whitening_of_far_vectors_is_exact(spark):
    far = [(i, [float(2**40 * i), float(-(2**30) * i * i), 1.0]) for i in range(5)]
    n, _, _, deviation = 5, None, None, {
        i: sum((5 * a - s) ** 2 for a, s in zip(
            (64 * 2**40 * i, -64 * 2**30 * i * i, 64), (64 * 2**40 * 10, -64 * 2**30 * 30, 320), strict=True
        )) for i in range(5)
    }
    rows = whitening.whiten(table(spark, far)).collect()
    assert {r.n for r in rows} == {n}
    assert {r.vec_id: int(r.deviation) for r in rows} == deviation


@pytest.mark.parametrize("name", ["op12_embedding_whitening", "op13_centroid_clusters"])
def test_no_vectors_give_no_rows(spark, tmp_path, name):
    empty = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    empty.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_float_vectors_are_taken_as_doubles(spark):
    rows = [(i, [0.1 * i] * 64) for i in range(4)]
    as_float = table(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    exact = [[math.floor(1024 * float(np.float32(0.1 * i)))] * 64 for i in range(4)]
    assert sorted(centroids.cluster(as_float, k=4, rounds=0).centroids) == sorted(exact)
