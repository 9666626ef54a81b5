"""Centroid clustering against plain integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from storepulse.llm.centroids import VantageTree, cluster

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       *(T.StructField(c, T.StringType()) for c in ("cluster", "distance", "id", "vector", "n", "total"))])


def brute(rows, k, rounds, width):
    kept = [(i, [math.floor(Fraction(c) * 1024) for c in v]) for i, v in rows
            if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    name = lambda i: "" if i is None else str(i)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{name(r[0])}".encode()).hexdigest(), r[0] or 0, r[1]))
    centroids = [v for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((square(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, near) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    near = assign()
    fit = lambda x: x if x < 2**63 else None
    each = {n: sum(d for d, c in near if c == n) for n in range(len(centroids))}
    whole = {n: all(d < 2**63 for d, c in near if c == n) for n in each}
    total = fit(sum(each.values())) if all(whole.values()) else None
    return sorted(((i, n, fit(d), fit(each[n]) if whole[n] else None, total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, near)), key=str)


def found(spark, rows, k=8, rounds=10, width=6):
    df = spark.createDataFrame([(i, v, *["x"] * 6) for i, v in rows], SCHEMA).repartition(3)
    out = cluster(df, k, rounds, width=width)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def vectors(n, width=6, seed=1, scale=1.0):
    rng = random.Random(seed)
    return [(i, [scale * rng.gauss(0, 1) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_equals_brute_force(spark, rounds):
    rows = vectors(300) + [(400, None), (401, []), (402, [None] * 6), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [1.0] * 5),
                           (406, [1.0] * 7), (None, [0.5] * 6), (7, vectors(300)[7][1]), (7, vectors(300)[7][1]), (8, [0.1] * 6)]
    assert found(spark, rows, rounds=rounds) == brute(rows, 8, rounds, 6)


def test_ties_go_to_the_smaller_number(spark):
    """Points of a coarse grid: many lie as near to one centroid as to another."""
    rng = random.Random(2)
    rows = [(i, [rng.randint(0, 2) / 1024 for _ in range(3)]) for i in range(200)]
    assert found(spark, rows, k=20, width=3) == brute(rows, 20, 10, 3)


def test_one_vector_for_all(spark):
    rows = [(i, [0.25] * 6) for i in range(50)]
    assert found(spark, rows) == brute(rows, 8, 10, 6)


@pytest.mark.parametrize("scale", [1e6, 1e9, 1e250])
def test_large_components_stay_exact(spark, scale):
    rows = vectors(60, scale=scale) + vectors(20, seed=5)
    assert found(spark, rows, k=4, rounds=4) == brute(rows, 4, 4, 6)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    assert found(spark, vectors(n)) == brute(vectors(n), 8, 10, 6)


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    spread = [2, 5, 1000, 2**25][seed]
    points = rng.integers(-spread, spread, (90, 4))
    vectors_ = rng.integers(-spread, spread, (500, 4))
    number, d2 = VantageTree(points.tolist()).assign(vectors_)
    far = ((vectors_[:, None] - points[None]) ** 2).sum(axis=2)
    assert (number == far.argmin(axis=1)).all() and (d2 == far.min(axis=1)).all()
