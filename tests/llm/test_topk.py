import math
import random

import numpy as np

from pyspark.sql import types as T

from storepulse.llm.topk import exact_top_k

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("rank", T.StringType()), T.StructField("id", T.StringType()), T.StructField("block", T.StringType())])


def brute(rows, k, every):
    usable = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
              if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)


def found(spark, rows, k=5, every=10, **blocks):
    df = table(spark, rows)
    return sorted(tuple(r) for r in exact_top_k(df, df.where(f"vec_id % {every} = 0"), k, **blocks).collect())


def vectors(n, width, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.randint(-200, 200) / 256 for _ in range(width)]) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(300, 12)
    rows += [(400, None), (410, []), (420, [None] * 12), (430, [float("nan")] * 12), (440, [float("inf")] + [0.0] * 11),
             (450, [0.0] * 12), (460, [0.5] * 5), (None, [0.1] * 12)]
    rows += [(500 + i, rows[7][1]) for i in range(40)]  # ties
    expect = brute(rows, 5, 10)
    assert found(spark, rows) == expect
    assert found(spark, rows, data_block=40, query_block=7) == expect


def test_fewer_candidates_than_k(spark):
    assert found(spark, vectors(3, 4), k=5, every=1) == brute(vectors(3, 4), 5, 1)
    assert found(spark, vectors(1, 4)) == []


def test_all_the_same_vector(spark):
    rows = [(i, [0.25, -0.5]) for i in range(120)]
    assert found(spark, rows, data_block=16) == brute(rows, 5, 10)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_components_of_any_size(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    rng = random.Random(6)

    def exact(c):
        return math.floor(256 * c) if abs(c) < 2**53 else int(c) * 256

    for sizes in ([1.0, 1e6], [1e6], [1.0, 3e7, 1e9, 1e14], [1e-3, 1e20, 3e38], [1.0, 1e200, 1.7e308], [1 / 256, 1.7e308]):
        rows = [(i, [rng.choice([-1, 1]) * rng.random() * rng.choice(sizes) for _ in range(6)]) for i in range(80)]
        rows += [(90, rows[0][1]), (91, rows[0][1]), (92, [float("inf")] * 6)]
        ints = {i: [exact(c) for c in v] for i, v in rows if i != 92}
        expect = []
        for q in (i for i in ints if i % 10 == 0):
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), j) for j, v in ints.items() if j != q)[:5]
            expect += [(q, r + 1, j, -s if -2**63 <= -s < 2**63 else None) for r, (s, j) in enumerate(scored)]
        df = spark.createDataFrame(rows, schema)
        assert sorted(map(tuple, exact_top_k(df, df.where("vec_id % 10 = 0"), 5, data_block=30, query_block=4).collect())) == sorted(expect)


def test_blocks_of_queries_are_not_multiplied_in_a_broadcast(spark, monkeypatch):
    """The planner sees the queries before each block of them is sent to every part of the data."""
    from storepulse.llm import topk
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)], "vec_id long, embedding array<double>")
    asked, seen, real = df.where("vec_id % 20 = 0"), [], topk.map_batches
    monkeypatch.setattr(topk, "map_batches", lambda pairs, *a: (seen.append(pairs), real(pairs, *a))[1])
    want = sorted(map(tuple, topk.exact_top_k(df, asked, k=3).collect()))
    for most in (topk.PARTS, 2):
        monkeypatch.setattr(topk, "PARTS", most)
        out = topk.exact_top_k(df, asked, k=3, data_block=10, query_block=4)      # 30 blocks of data
        assert sorted(map(tuple, out.collect())) == want
        pairs = seen[-1]
        pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        blocks, parts = (30, 30) if most > 30 else (30, 15)
        assert pairs.select("part").distinct().count() <= parts
        queries = pairs.select("q_ids").distinct().count()
        assert pairs.count() == queries * pairs.select("block").distinct().count()
