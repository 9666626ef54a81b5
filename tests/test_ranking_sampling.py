"""Properties: the distributed operators equal their single-partition forms."""

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from storepulse.operators.ranking import exact_rank
from storepulse.operators.sampling import exact_hash_select, hash_hex

values = st.lists(st.one_of(st.none(), st.integers(min_value=-5, max_value=30)), min_size=1, max_size=120)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, buckets=st.sampled_from([2, 7]))
def test_exact_rank_matches_window_rank(spark, vals, buckets):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(vals)], "id int, v double")
    want = {r.id: r.rk for r in df.select(
        "id", F.rank().over(Window.orderBy(F.col("v").desc_nulls_last())).alias("rk")).collect()}
    got = {r.id: r.rank for r in exact_rank(df, "v", width=buckets).collect()}
    assert got == want


def test_exact_rank_ascending(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "id int, v double")
    want = {r.id: r.rk for r in df.select("id", F.rank().over(Window.orderBy("v")).alias("rk")).collect()}
    got = {r.id: r.rank for r in exact_rank(df, "v", desc=False, width=2).collect()}
    assert got == want


def _reference_select(df, key, k_by_stratum, strata, seed, tag):
    w = Window.partitionBy(*strata).orderBy(hash_hex(seed, tag, key), key)
    rn = df.withColumn("_rn", F.row_number().over(w))
    sel = set()
    for r in rn.collect():
        if r["_rn"] <= k_by_stratum[tuple(r[s] for s in strata)]:
            sel.add(r[key])
    return sel


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(min_value=0, max_value=400), share=st.sampled_from(["0", "0.12", "0.5", "1", "1.7"]),
       prefix=st.sampled_from([1, 2, 4]))
def test_exact_hash_select_equals_row_number(spark, n, share, prefix):
    df = spark.createDataFrame([(f"k{i}", f"s{i % 3}") for i in range(n)], "key string, s string")
    k_fn = lambda tot: F.floor(tot * F.lit(Decimal(share)))
    got = exact_hash_select(df, "key", k_fn, seed=3, tag="t", strata=["s"], digits=prefix)
    sel = {r.key for r in got.filter("selected").collect()}
    assert got.count() == n
    totals = {}
    for i in range(n):
        totals[(f"s{i % 3}",)] = totals.get((f"s{i % 3}",), 0) + 1
    k = {s: int(Decimal(t) * Decimal(share)) for s, t in totals.items()}
    assert sel == _reference_select(df, "key", k, ["s"], 3, "t")
    assert len(sel) == sum(min(v, totals[s]) for s, v in k.items())


def test_exact_hash_select_global(spark):
    df = spark.createDataFrame([(f"o{i}",) for i in range(1000)], "key string")
    got = exact_hash_select(df, "key", lambda t: F.round(t * F.lit(Decimal("0.12")), 0), tag="x")
    assert got.filter("selected").count() == 120


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=150),
       buckets=st.sampled_from([2, 8]))
def test_exact_percentiles_match_percentile(spark, vals, buckets):
    from storepulse.operators.ranking import exact_percentiles
    rows = [(i % 3, v / 4.0) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, x double")
    qs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    want = {r.g: list(r.p) for r in df.groupBy("g").agg(F.percentile("x", qs).alias("p")).collect()}
    got = {r.g: [r[f"p{i}"] for i in range(len(qs))]
           for r in exact_percentiles(df, "x", qs, ["g"], width=buckets).collect()}
    assert got.keys() == want.keys()
    for g in want:
        for a, b in zip(got[g], want[g]):
            assert abs(a - b) <= 1e-9 * max(1.0, abs(b))


def test_exact_rank_partitioned(spark):
    df = spark.createDataFrame([(i % 4, float((i * 7) % 11)) for i in range(80)], "g int, v double")
    want = {(r.g, r.v): r.rk for r in df.select(
        "g", "v", F.rank().over(Window.partitionBy("g").orderBy("v")).alias("rk")).collect()}
    got = {(r.g, r.v): r.rank for r in exact_rank(df, "v", desc=False, width=2, partition_cols=["g"]).collect()}
    assert got == want


PARTITIONED = [(None, 3.0), (None, 4.0), (None, None), ("a", 1.0), ("a", 1.0), ("a", 2.0), ("only null", None), ("b", -1.0)]


@pytest.mark.parametrize("desc", [True, False])
@pytest.mark.parametrize("width", [2, 64])
@pytest.mark.parametrize("rows", [PARTITIONED, [], [(None, None)]])
def test_exact_rank_null_partitions(spark, rows, width, desc):
    df = spark.createDataFrame(rows, "g string, v double")
    order = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_last()
    want = df.select("g", "v", F.rank().over(Window.partitionBy("g").orderBy(order)).alias("rank"))
    got = exact_rank(df, "v", desc=desc, width=width, partition_cols=["g"])
    assert sorted(map(str, got.select("g", "v", "rank").collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("width", [2, 64])
def test_exact_percentiles_null_partitions(spark, width):
    from storepulse.operators.ranking import exact_percentiles
    df = spark.createDataFrame(PARTITIONED, "g string, v double")
    want = df.groupBy("g").agg(*[F.percentile("v", q).alias(f"p{i}") for i, q in enumerate((0.25, 0.5))])
    got = exact_percentiles(df, "v", [0.25, 0.5], ["g"], width=width)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    empty = spark.createDataFrame([], "g string, v double")
    assert exact_percentiles(empty, "v", [0.5], ["g"], width=width).count() == 0
    assert exact_percentiles(empty, "v", [0.5], width=width).collect()[0]["p0"] is None


@pytest.mark.parametrize("digits", [1, 4])
@pytest.mark.parametrize("strata", [[], ["s"]])
@pytest.mark.parametrize("k", [0, 1, 2, 3, 10, None])
def test_exact_hash_select_edges(spark, digits, strata, k):
    rows = [(f"k{i}", s) for i, s in enumerate([None, None, None, "a", "a", "a", "a", "b", "b"])]
    for data in (rows, []):
        df = spark.createDataFrame(data, "key string, s string")
        got = exact_hash_select(df, "key", lambda _: F.lit(k), strata=strata, digits=digits).collect()
        assert len(got) == len(data) and all(r["selected"] is not None for r in got)
        groups = {}
        for r in got:
            groups.setdefault(r["s"] if strata else "", []).append(r["selected"])
        assert all(sum(g) == min(len(g), k or 0) for g in groups.values())


def test_ranks_do_not_depend_on_the_ranges(spark):
    """Equal values share a range, also one that a third of all rows have, whatever the ranges are."""
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 41).otherwise(F.col("id") * 7919 % 5003).cast("double").alias("v")).repartition(5)
    want = {r.id: r.rk for r in df.select("id", F.rank().over(Window.orderBy(F.desc("v"))).alias("rk")).collect()}
    for width in (1, 3, 50, None):
        assert {r.id: r["rank"] for r in exact_rank(df, "v", width=width).collect()} == want


def test_a_ranked_aggregate_reads_the_facts_once(spark, small_tables):
    from storepulse.plans.pickers import picker_productivity
    _, T = small_tables
    plan = picker_productivity(T)._jdf.queryExecution().executedPlan().toString()
    assert "fact_picker_activity" not in plan and "approx" not in plan and plan.count("FileScan") <= 8


def test_no_job_runs_while_the_plan_is_built(spark):
    df = spark.createDataFrame(PARTITIONED, "g string, v double")
    spark.sparkContext.setJobGroup("plan-only", "")
    exact_hash_select(df, "v", lambda t: t / 2, strata=["g"])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")
    spark.sparkContext.setJobGroup("tests", "")
    assert not jobs


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "hot"])),
                               st.integers(min_value=0, max_value=5), st.integers(min_value=0, max_value=3)),
                     min_size=1, max_size=60))
def test_keep_first_matches_row_number(spark, rows):
    from storepulse.operators.cleaning import _keep_first
    rows = rows + [("hot", 9, i % 4) for i in range(30)]          # one key holds many rows
    df = spark.createDataFrame(rows, "k string, ts int, v int")
    key = lambda t: tuple("" if x is None else str(x) for x in t)
    got = sorted((tuple(r) for r in _keep_first(df, ["k"], ["ts"]).select("k", "ts", "v", "_dups").collect()),
                 key=key)
    w = Window.partitionBy("k").orderBy("ts", "v")
    ref = (df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("k")))
           .filter("_rn = 1").select("k", "ts", "v", (F.col("_n") - 1).alias("_dups")))
    assert got == sorted((tuple(r) for r in ref.collect()), key=key)
