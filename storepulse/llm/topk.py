"""Exact top-k search by inner product with vector-approximation files.

Components are quantised to integers, ``floor(SCALE * x)``.  A data block keeps each
integer vector and its approximation: for every dimension the number of the cell that
holds the component.  For a query a scan over the cells gives lower and upper bounds of
every score; exact vectors are then read in the order of their bounds, best first, until
no bound left can reach the kth exact score.  Results are therefore exact.

Queries are cut into blocks and meet every data block; each pair of blocks returns k rows
for each query, and the best k of those are ranked.  A task holds one pair of blocks, so
its memory is bounded whatever the number of queries and vectors.  Data blocks are dealt to
parts, and a block of queries travels once to each part; neither side is ever broadcast.

Whether scores of a pair of blocks fit into 64 bits follows from its real width and largest
components; where they may not, that pair is computed in Python's integers.  A score beyond
64 bits is ranked by its exact value and returned as null.

A vector that is null or empty, or holds a null or a non-finite component, takes no part.
Vectors of different lengths are compared as if padded with zeros.  Rows
that repeat an identifier are each candidates; a query never meets its own identifier.
A null identifier takes no part.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.llm.common import map_batches, on_workers_path, written

SCALE = 256
CELLS = 16
DATA_BLOCK = 4096
QUERY_BLOCK = 256
#: Parts that data blocks are dealt to, where there are as many; beyond ``PARTS`` blocks a part there are more.
PARTS = 64
#: Up to this size a component times ``SCALE`` has its floor within 64 bits; larger doubles are whole numbers.
WHOLE = 2.0**53
LARGEST = float(np.finfo(np.float64).max)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Identifier and components of the vectors that take part, each cut to a whole number of ``1 / SCALE``."""
    x = F.col(vector_col)
    cut = F.transform(F.transform(x, lambda c: c.cast("double")),
                      lambda c: F.when(F.abs(c) < WHOLE, F.floor(F.lit(float(SCALE)) * c).cast("double") / F.lit(float(SCALE))).otherwise(c))
    usable = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(usable).select(F.col(id_col).cast("long").alias("id"), cut.alias("vector"))


def blocked(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Vectors with a block number; a block holds about ``size`` of them."""
    count = vectors.count()
    blocks = max(1, -(-count // size))
    return vectors.withColumn("block", F.pmod(F.xxhash64("id", F.lit(name)), F.lit(blocks)).cast("int"))


class Approximation:
    """The vector-approximation file of one data block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cells: int = CELLS):
        self.ids, self.vectors = ids, vectors
        # cell limits by quantiles, so that cells are evenly filled
        near = as_doubles(vectors)
        marks = np.quantile(near, np.linspace(0, 1, cells + 1), axis=0, method="lower") if len(vectors) else \
            np.zeros((cells + 1, vectors.shape[1]))
        self.marks = marks.astype(np.float64)
        self.cell = np.empty(vectors.shape, dtype=np.uint8)
        for d in range(vectors.shape[1]):
            inner = self.marks[1:-1, d]
            self.cell[:, d] = np.searchsorted(inner, near[:, d], side="right")

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of each query's score with each vector, from the cells alone."""
        at, queries = np.arange(self.cell.shape[1]), as_doubles(queries)
        low, high = self.marks[self.cell, at], self.marks[self.cell + 1, at]
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        with np.errstate(over="ignore", invalid="ignore"):
            # sums beyond 2**53 round; the bounds give way by as much
            slack = np.abs(queries) @ np.abs(self.marks).max(axis=0) * (len(at) * 2.0**-52)
            lower, upper = up @ low.T + down @ high.T - slack[:, None], up @ high.T + down @ low.T + slack[:, None]
        # where doubles overflow nothing is known
        lost = ~(np.isfinite(lower) & np.isfinite(upper))
        lost |= (np.abs(queries).max(axis=1, initial=0) >= LARGEST)[:, None] | (np.abs(self.marks).max(initial=0) >= LARGEST)
        lower[lost], upper[lost] = -np.inf, np.inf
        return lower, upper

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, group: int = 32) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its k best (row of the block, score) apart from itself; ties to the smaller id."""
        lower, upper = self.bounds(queries)
        plain = self.vectors.dtype != object
        for q, (own, query) in enumerate(zip(query_ids, queries)):
            others = np.flatnonzero(self.ids != own)
            if not len(others):
                continue
            # what cannot reach the kth lower bound is never read
            if len(others) > k:
                floor = np.partition(lower[q, others], len(others) - k)[len(others) - k]
                others = others[upper[q, others] >= floor]
            order = others[np.argsort(-upper[q, others], kind="stable")]
            rows, scores = np.empty(0, np.int64), np.empty(0, self.vectors.dtype)
            for begin in range(0, len(order), group):
                if len(scores) >= k and (upper[q, order[begin]] if plain else float(upper[q, order[begin]])) < scores[k - 1]:
                    break
                read = order[begin:begin + group]
                rows = np.concatenate([rows, read])
                scores = np.concatenate([scores, self.vectors[read] @ query])
                keep = np.lexsort((self.ids[rows], -scores))[:k] if plain else \
                    np.array(sorted(range(len(rows)), key=lambda r: (-scores[r], self.ids[rows[r]]))[:k])
                rows, scores = rows[keep], scores[keep]
            yield q, rows, scores


def as_doubles(vectors: np.ndarray) -> np.ndarray:
    """Integer vectors as doubles; what is beyond their range is the largest of them, for which there are no bounds."""
    if vectors.dtype != object:
        return vectors.astype(np.float64)
    top = int(LARGEST)
    return np.array([float(max(-top, min(top, x))) for x in vectors.flat], np.float64).reshape(vectors.shape)


def _packed(df: DataFrame) -> DataFrame:
    """One row for each block: its identifiers, vector lengths and components as bytes.

    The components are 32-bit integers, or where these don't hold them the doubles before scaling (``wide``)."""
    def pack(table: pa.Table) -> pa.Table:
        vectors = table.column("vector").combine_chunks()
        data = vectors.flatten().to_numpy(zero_copy_only=False)
        wide = bool(len(data)) and float(np.abs(data).max()) >= 2.0**31 / SCALE
        columns = {"ids": table.column("id").to_numpy().astype(np.int64), "lengths": vectors.value_lengths().to_numpy().astype(np.int64),
                   "data": data if wide else (data * SCALE).astype(np.int32)}
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "wide": pa.array([wide]),
                         **{k: pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()}})

    return df.groupBy("block").applyInArrow(pack, "block int, wide boolean, ids binary, lengths binary, data binary")


def _unpacked(ids: bytes, lengths: bytes, data: bytes, wide: bool, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers and integer vectors, padded with zeros to the same width; Python's integers where they are wide."""
    length = np.frombuffer(lengths, np.int64)
    out = np.zeros((len(length), width), dtype=object if wide else np.int64)
    if wide:  # whole numbers of 1 / SCALE, so the products are exact
        found = np.array([int(c * SCALE) if abs(c) < WHOLE else int(c) * SCALE for c in np.frombuffer(data, np.float64).tolist()], object)
    else:
        found = np.frombuffer(data, np.int32)
    out[np.arange(width) < length[:, None]] = found
    return np.frombuffer(ids, np.int64), out


def fit_64(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether all inner products of the two blocks, and the sums on the way, fit into 64 bits."""
    return int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * x.shape[1] < 1 << 63


def sortable(score: int) -> bytes:
    """Bytes in the order of integers of the same sign."""
    size = abs(score).bit_length() // 8 + 1
    magnitude = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return magnitude if score >= 0 else bytes(255 - b for b in magnitude)


def exact_top_k(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the found identifier and ``score``: the k best of ``df`` for every query."""
    on_workers_path(df.sparkSession)
    data = written(_packed(blocked(usable_vectors(df, id_col, vector_col), data_block, "data")), "data_blocks")
    asked = usable_vectors(queries, id_col, vector_col).dropDuplicates(["id", "vector"])
    # every block of queries meets every block of data; merged, as the planner sees the queries before they are multiplied
    blocks = (data.agg(F.max("block")).first()[0] or 0) + 1
    parts = min(blocks, max(PARTS, -(-blocks // PARTS)))
    pairs = (_packed(blocked(asked, query_block, "queries"))
             .select(*[F.col(c).alias(f"q_{c}") for c in ("wide", "ids", "lengths", "data")],
                     F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
             .join(data.withColumn("part", F.col("block") % parts).hint("merge"), "part"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                width = max(int(np.frombuffer(row[c], np.int64).max()) for c in ("lengths", "q_lengths"))
                ids, vectors = _unpacked(row["ids"], row["lengths"], row["data"], row["wide"], width)
                query_ids, wanted = _unpacked(row["q_ids"], row["q_lengths"], row["q_data"], row["q_wide"], width)
                if not fit_64(vectors, wanted):
                    vectors, wanted = vectors.astype(object), wanted.astype(object)
                found = [(np.full(len(at), query_ids[q]), ids[at], scores)
                         for q, at, scores in Approximation(ids, vectors).best(query_ids, wanted, k)]
                if found:
                    query, own, scores = (np.concatenate(x) for x in zip(*found))
                    scores = scores.tolist()
                    side = [(s >= 1 << 63) - (s < -1 << 63) for s in scores]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query, pa.int64()), pa.array(own, pa.int64()), pa.array(side, pa.int32()),
                         pa.array([None if b else s for s, b in zip(scores, side)], pa.int64()),
                         pa.array([sortable(s) if b else None for s, b in zip(scores, side)], pa.binary())],
                        names=["query_id", "id", "side", "score", "beyond"])

    best = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("beyond"), "id")
    return (map_batches(pairs, search, "query_id long, id long, side int, score long, beyond binary")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
