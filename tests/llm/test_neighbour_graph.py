"""The neighbour graph and its search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storepulse.llm import neighbour_graph
from storepulse.llm.neighbour_graph import NeighbourGraph, cosine, nearest

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       *(T.StructField(c, T.StringType()) for c in ("rank", "id", "block", "node", "score", "query_id"))])


def table(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * 6) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=5, every=10):
    fit = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and any(v)
                  and all(c is not None and math.isfinite(c) for c in v)})
    width = max((len(v) for _, v in fit), default=0)
    x = np.array([v + (0.0,) * (width - len(v)) for _, v in fit]).reshape(len(fit), width)
    ids = np.array([i for i, _ in fit])
    out = []
    for row in range(len(fit)):
        if ids[row] % every == 0:
            score = cosine(np.repeat(x[row:row + 1], len(x), axis=0), x)
            best = [b for b in np.lexsort((ids, -score)) if ids[b] != ids[row]][:k]
            out += [(int(ids[row]), r + 1, int(ids[b]), float(score[b])) for r, b in enumerate(best)]
    return sorted(out)


def found(spark, rows, every=10, **options):
    df = table(spark, rows)
    return sorted(tuple(r) for r in nearest(df, df.where(f"vec_id % {every} = 0"), **options)
                  .select("query_id", "rank", "vec_id", "score").collect())


def vectors(n, width, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) for _ in range(width)]) for i in range(n)]


def test_recall_in_many_dimensions(spark):
    rows = vectors(4000, 48)
    df = table(spark, rows)
    graph = NeighbourGraph(df, degree=32, block=256)
    assert len(graph.changes) > 2                                # the first graph was not enough
    got = {(r.query_id, r.vec_id) for r in graph.search(df.where("vec_id % 50 = 0")).collect()}
    expect = {(q, v) for q, _, v, _ in brute(rows, every=50)}
    assert len(got) == len(expect) and len(got & expect) >= 0.9 * len(expect)


def test_every_row_has_a_node_with_its_nearest(spark):
    rows = vectors(1500, 8)
    graph = NeighbourGraph(table(spark, rows), degree=24, block=128)
    lists = {r.node: set(r.ids[:5]) for r in graph.graph.collect()}
    assert lists.keys() == {i for i, _ in rows}
    expect = brute(rows, every=1)
    assert sum(v in lists[q] for q, _, v, _ in expect) >= 0.9 * len(expect)


def test_blocks_propose_to_parts(spark, monkeypatch):
    """Every block names nearly every node, yet sends no row for each of them."""
    monkeypatch.setattr(neighbour_graph, "PART", 300)
    for n in (400, 2000):
        built = NeighbourGraph(table(spark, vectors(n, 24)), degree=16, block=100, rounds=0)
        blocks = built.graph.select("block").distinct().count()
        proposed = neighbour_graph._proposals(built.graph, 16, 0, built.parts, built.tables)
        rows, named, listed = proposed.agg(F.count(F.lit(1)), F.sum(F.size("nodes")), F.sum(F.size("ids"))).first()
        assert blocks > n // 200 and built.parts == -(-n // 300)
        assert rows <= blocks * built.parts
        assert named > 2 * n and listed > named                  # a row each before
        nodes = {x for r in proposed.select("nodes").collect() for x in r.nodes}
        assert len(nodes) > 0.9 * n


def test_parts_keep_entries_with_their_nodes():
    node = np.array([7, 7, -3, 12, 12, 12, 5])
    dealt = neighbour_graph._found(node, np.arange(7), np.arange(7) / 8, 3)
    assert len(dealt) == len(set(neighbour_graph.part_of(node, 3)))
    back = zip(neighbour_graph._owners(dealt), neighbour_graph._flat(dealt, "ids"), neighbour_graph._flat(dealt, "scores"))
    assert sorted(back, key=lambda x: x[1]) == [(n, i, i / 8) for i, n in enumerate(node)]
    for row in dealt.to_pylist():
        assert set(neighbour_graph.part_of(np.array(row["nodes"]), 3)) == {row["part"]}
    assert len(neighbour_graph._found(node[:0], node[:0], np.empty(0), 3)) == 0


def test_awkward_rows_equal_brute_force(spark):
    rows = vectors(120, 6)
    rows += [(200, None), (210, []), (220, [None] * 6), (230, [float("nan")] * 6), (240, [float("inf")] + [0.0] * 5), (250, [0.0] * 6),
             (260, [0.5] * 3), (None, [0.1] * 6), (270, [1e200] * 6), (280, [1e-200] + [0.0] * 5), (-30, [-1.0] * 6)]
    rows += [(20, rows[20][1]), (20, rows[20][1]), (30, rows[31][1])]        # repeated rows; one identifier, two vectors
    assert found(spark, rows) == brute(rows)


def test_copies_give_the_smallest_identifiers(spark):
    """A third of all rows hold one vector."""
    rows = vectors(200, 5) + [(1000 + i, [0.3, -0.2, 0.9, 0.0, 0.1]) for i in range(100)]
    assert found(spark, rows) == brute(rows)


def test_queries_that_are_not_indexed(spark):
    rows = vectors(600, 6)
    asked = [(i + 10_000, v) for i, v in vectors(20, 6, seed=9)]
    got = NeighbourGraph(table(spark, rows), degree=24, block=128).search(table(spark, asked))
    expect = {(q, v) for q, _, v, _ in (b for b in brute(rows + asked, k=30, every=1) if b[0] >= 10_000) if v < 10_000}
    got = [(r.query_id, r.vec_id) for r in got.collect()]
    assert len(got) == 100 and set(got) <= expect


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_fewer_candidates_than_k(spark, n):
    assert found(spark, vectors(n, 4), every=1) == brute(vectors(n, 4), every=1)
