"""Centroid clustering in exact integers, with a vantage-point tree over the centroids.

Vectors of ``width`` components, none null or non-finite, are turned into integers,
``floor(SCALE * x)``.  The first centroids are the vectors whose identifiers have the smallest
hashes.  Each round every vector goes to its nearest centroid by squared Euclidean distance
(ties to the smaller number), and each non-empty centroid becomes the componentwise
``floor(sum / count)`` of its vectors.

**Search.**  Each round a vantage-point tree over the distinct centroids is built and broadcast;
its size is bounded by the number of centroids, a parameter.  A node holds one centroid and, for
each half of the others, the least and the greatest distance from it.  A vector visits nodes best
first, by the lower bound that the triangle inequality gives; a branch is left out only if its
bound lies above the best distance, a margin for rounding included, so that ties are seen.
Distances themselves are compared as integers.  Batches of vectors walk the tree together, each in
its own order.

Tasks return one sum of components for each centroid that they meet; Spark adds these up, so a
centroid that holds a third of all vectors costs no more than another.  Only centroids come to the
driver.

Where no squared distance can reach ``NARROW``, components are 64-bit integers; for a table with
larger ones the same code runs on Python's integers.  A distance or an inertia beyond 64 bits is null; the
clusters and centroids stay exact.  Repeated rows each count and are all returned; of rows with one
identifier, the smaller vector comes first among the first centroids.  A null identifier is hashed
as an empty text and sorts first.  With fewer vectors than centroids, there are fewer centroids;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import map_batches, on_workers_path, written

SCALE = 1024
#: Squared distances below this fit 64 bits with room to spare.
NARROW = 2**62
#: Vectors times tree nodes that one step holds.
CELLS = 1 << 20
_MOST = 2**63 - 1


def usable(df: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """Identifier and vector of the rows that take part, as doubles."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fit = (F.size(vector_col) == width) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return df.where(fit).select(F.col(id_col).cast("long").alias("id"), x.alias("vector"))


def integers(column: pa.Array, width: int, wide: bool) -> np.ndarray:
    """The integer components of a list column, a row for each vector; Python's integers where ``wide``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if not wide:
        return np.floor(SCALE * x).astype(np.int64)
    out = np.empty(x.shape, dtype=object)
    out.ravel()[:] = [math.floor(Fraction(float(c)) * SCALE) for c in x.ravel()]
    return out


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector from the point."""
    gap = vectors - point
    return (gap * gap).sum(axis=1)


def _length(d2: int) -> float:
    try:
        return math.sqrt(d2)
    except OverflowError:                               # beyond a double; the root may still be within
        root = math.isqrt(d2)
        return float(root) if root < 2**1023 else math.inf


def _root(d2: np.ndarray) -> np.ndarray:
    """Distances from exact squares."""
    return np.sqrt(d2.astype(np.float64)) if d2.dtype != object else np.array([_length(d) for d in d2], dtype=np.float64)


class VantageTree:
    """A vantage-point tree over distinct centroids; nodes are numbered, children follow parents."""

    def __init__(self, centroids: list[list[int]], wide: bool = False):
        kind = object if wide else np.int64
        first: dict[tuple[int, ...], int] = {}
        for number, c in enumerate(centroids):
            first.setdefault(tuple(c), number)          # of equal centroids only the smallest number can win
        self.points = np.empty((len(first), len(centroids[0]) if centroids else 0), dtype=kind)
        for row, c in enumerate(first):
            self.points[row] = np.array(c, dtype=kind)
        self.numbers = np.array(list(first.values()), dtype=np.int64)
        self.order: list[int] = []                      # row of ``points`` of each node
        self.children: list[list[tuple[int, float, float]]] = []    # (node, least, greatest distance)
        if len(first):
            self._build(np.arange(len(first)))

    def _build(self, rows: np.ndarray) -> int:
        # the vantage point is the one farthest from the first, which spreads distances
        spread = _root(squared(self.points[rows], self.points[rows[0]]))
        at = int(np.argmax(spread))
        here, others = rows[at], np.delete(rows, at)
        node = len(self.order)
        self.order.append(int(here))
        self.children.append([])
        if len(others):
            far = _root(squared(self.points[others], self.points[here]))
            by = np.argsort(far, kind="stable")
            half = (len(by) + 1) // 2
            for part in (by[:half], by[half:]):
                if len(part):
                    self.children[node].append((self._build(others[part]), float(far[part].min()), float(far[part].max())))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each vector; ties to the smaller number."""
        count, nodes = len(vectors), len(self.order)
        best = np.full(count, -1, dtype=np.int64)
        least = np.zeros(count, dtype=vectors.dtype)
        limit = np.full(count, np.inf)
        bound = np.full((count, nodes), np.inf)         # of the nodes that are open for a vector
        bound[:, 0] = -1.0
        active = np.arange(count)
        while len(active):
            pick = np.argmin(bound[active], axis=1)
            low = bound[active, pick]
            # inclusive: a branch at the very distance of the best may hold a smaller number
            going = (low < np.inf) & (low <= limit[active] * (1 + 1e-12))
            active, pick = active[going], pick[going]
            for node in np.unique(pick):
                rows = active[pick == node]
                low = bound[rows, node]
                bound[rows, node] = np.inf
                d2 = squared(vectors[rows], self.points[self.order[node]])
                number = self.numbers[self.order[node]]
                wins = (best[rows] < 0) | (d2 < least[rows]) | ((d2 == least[rows]) & (number < best[rows]))
                won = rows[wins]
                best[won], least[won] = number, d2[wins]
                distance = _root(d2)
                limit[won] = distance[wins]
                for child, nearer, farther in self.children[node]:
                    gap = np.maximum(nearer - distance, distance - farther)
                    gap = gap - (distance + farther) * 1e-12          # what rounding could take
                    bound[rows, child] = np.maximum(low, np.where(np.isfinite(gap), gap, -1.0))
        return best, least

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` in steps of bounded memory."""
        step = max(1, CELLS // max(1, len(self.order)))
        parts = [self.nearest(vectors[b:b + step]) for b in range(0, len(vectors), step)]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, vectors.dtype)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _sums(tree, width: int, wide: bool):
    """Per task and centroid: the number of vectors and, for each component, the sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            vectors = integers(batch.column("vector"), width, wide)
            number, _ = tree.value.assign(vectors)
            for c in np.unique(number):
                mine = vectors[number == c]
                n, held = total.get(int(c), (0, 0))
                total[int(c)] = (n + len(mine), held + mine.sum(axis=0).astype(object))    # Python's integers do not overflow
        rows = [(c, d, n, str(s)) for c, (n, sums) in total.items() for d, s in enumerate(sums)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.string()))],
                                             names=["cluster", "d", "n", "total"])
    return run


def _moved(vectors: DataFrame, tree, centroids: list[list[int]], width: int, wide: bool) -> list[list[int]]:
    """The centroids after one round."""
    parts = map_batches(vectors, _sums(tree, width, wide), "cluster int, d int, n long, total string")
    if wide:
        def add(table: pa.Table) -> pa.Table:
            return pa.table({"cluster": table.column("cluster")[:1], "d": table.column("d")[:1],
                             "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                             "total": pa.array([str(sum(map(int, table.column("total").to_pylist())))], pa.string())})
        sums = parts.groupBy("cluster", "d").applyInArrow(add, "cluster int, d int, n long, total string")
    else:
        sums = parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
    out = [list(c) for c in centroids]
    for r in sums.collect():                            # one row for each centroid and component
        out[r.cluster][r.d] = int(r.total) // r.n       # floors, below zero too
    return out


def _assigned(tree, width: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, d2 = tree.value.assign(integers(batch.column("vector"), width, wide))
            exact = [str(d) for d in d2.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()),
                                              pa.array([int(d) if d <= _MOST else None for d in d2.tolist()], pa.int64()),
                                              pa.array(exact, pa.string())], names=["id", "cluster", "distance", "exact"])
    return run


def first_centroids(vectors: DataFrame, k: int, seed: str) -> DataFrame:
    """The k vectors with the smallest hashes of ``seed`` and identifier, in that order."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return vectors.orderBy(key, F.col("id").asc_nulls_first(), "vector").limit(k)


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            width: int = 64, seed: str = "3:") -> DataFrame:
    """For each vector that takes part: its identifier, ``cluster``, squared ``distance``,
    ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    spark = df.sparkSession
    on_workers_path(spark)
    vectors = written(usable(df, id_col, vector_col, width), "vectors")
    greatest = vectors.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0.0
    wide = 2 * (greatest * SCALE + 1) >= math.sqrt(NARROW / width)
    start = first_centroids(vectors, k, seed).select("vector").collect()         # k rows
    centroids = [[math.floor(Fraction(c) * SCALE) for c in r.vector] for r in start]

    def planted(points: list[list[int]]):
        return spark.sparkContext.broadcast(VantageTree(points, wide))

    for _ in range(rounds if centroids else 0):
        tree = planted(centroids)
        moved = _moved(vectors, tree, centroids, width, wide)
        tree.unpersist()
        if moved == centroids:                          # every further round would repeat this one
            break
        centroids = moved
    found = written(map_batches(vectors, _assigned(planted(centroids), width, wide), "id long, cluster int, distance long, exact string"),
                    "assigned")
    total = F.expr("try_sum(try_cast(exact as decimal(38,0)))")
    each = found.groupBy("cluster").agg(F.expr("count(*) = count(distance)").alias("_fit"), total.alias("_sum"))
    whole = each.agg(F.expr("bool_and(_fit)").alias("_all_fit"), F.expr("try_sum(_sum)").alias("_all"))
    digests = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)],
                                    "cluster int, centroid_sha256 string")
    # a row for each centroid, and one row
    small = each.join(digests, "cluster").crossJoin(whole).select(
        "cluster", "centroid_sha256", F.when(F.col("_fit"), F.expr("try_cast(_sum as bigint)")).alias("cluster_inertia"),
        F.when(F.col("_all_fit"), F.expr("try_cast(_all as bigint)")).alias("inertia"))
    return found.join(F.broadcast(small), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia",
                                                            "centroid_sha256")
