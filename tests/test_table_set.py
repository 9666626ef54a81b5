"""Cleaned tables are built when they are first read, with little on the disk and in the driver."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMALL
from storepulse.operators import cleaning as C
from storepulse.operators.profiling import profile_duplicates
from storepulse.plans import tableset as S
from storepulse.plans.summaries import TableSet
from storepulse.sources import fixtures as X
from storepulse.sources import tables as IO
from storepulse.sources.schemas import TABLE_NAMES
from test_lines import _inputs, _rows


@pytest.fixture
def built(spark, monkeypatch, request):
    """The cleaned tables that are in a store of its own."""
    monkeypatch.setenv("STOREPULSE_NAMESPACE", re.sub(r"\W", "_", f"test-{request.node.name}-{os.getpid()}"))
    parts = f"{S._root(spark, SMALL)}/parts"
    return lambda: {n[6:-8] for n in (os.listdir(parts) if os.path.exists(parts) else []) if n.startswith("clean_") and n.endswith(".current")}


@pytest.mark.parametrize("name, tables", [
    ("clean_stores", {"dim_stores"}),
    ("monthly_growth", {"dim_stores", "fact_orders"}),
    ("profitable_share_updated", {"dim_stores", "fact_orders"}),
    ("acceptance_by_category", {"dim_stores", "fact_orders", "fact_substitutions"}),
    ("sql_monthly_growth", {"dim_stores", "fact_orders"}),
])
def test_a_query_has_its_own_tables_built_alone(spark, built, small_tables, monkeypatch, name, tables):
    out = _rows(E.queries()[name](spark, SMALL))
    assert out and built() == tables
    monkeypatch.delenv("STOREPULSE_NAMESPACE")       # where the whole set is there
    assert _rows(E.queries()[name](spark, SMALL)) == out


def test_the_rest_of_the_set_is_built_when_it_is_asked_for(spark, built, small_tables):
    E.queries()["clean_stores"](spark, SMALL)
    whole = S.clean_tables(spark, SMALL)
    assert built() == {*TABLE_NAMES} and {*whole} == {*TABLE_NAMES, "cleaning_audit"}
    assert _rows(whole["cleaning_audit"]) == _rows(small_tables[1]["cleaning_audit"]) == _rows(E.queries()["cleaning_audit"](spark, SMALL))


def test_waves_hold_what_cleaning_needs():
    assert C.with_parents([]) == []
    assert C.with_parents(["fact_substitutions", "dim_skus"]) == [["dim_stores", "dim_skus"], ["fact_orders"], ["fact_substitutions"]]
    assert {n for wave in C.with_parents(TABLE_NAMES) for n in wave} == {*TABLE_NAMES}


def test_a_table_set_is_a_dict_of_all_its_tables():
    asked = []
    T = TableSet({}, None, ["a", "b"], lambda names: asked.append(list(names)) or {n: n.upper() for n in names})
    assert T["b"] == "B" and asked == [["b"]] and "a" in T and "c" not in T and len(T) == 2 and list(T) == ["a", "b"]
    assert dict(T) == {**T} == {"a": "A", "b": "B"} and list(T.items()) == [("a", "A"), ("b", "B")] and list(T.values()) == ["A", "B"]
    assert asked == [["b"], ["a"]] and T.get("c") is None
    with pytest.raises(KeyError):
        T["c"]


def test_shuffle_files_of_a_build_are_removed_with_each_action(spark, tmp_path):
    key, seen = IO._CLEANUP, []
    before = spark.conf.get(key, None)

    def files():
        top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(len(fs) for d in top.localDirsString() for _, _, names in os.walk(d) if (fs := [n for n in names if n.startswith("shuffle_")]))

    def build(base):
        at_first = files()
        df = spark.range(20_000).withColumn("k", F.col("id") % 7).hint("rebalance", "k")
        df.write.parquet(f"{base}/t")
        seen.append(files() - at_first)
    base = S._publish(spark, str(tmp_path / "x"), build)
    assert seen[0] <= 0 and spark.read.parquet(f"{base}/t").count() == 20_000
    assert spark.conf.get(key, None) == before


def test_jobs_of_a_large_input_run_one_after_another(spark, monkeypatch):
    import threading
    import time
    now, most, lock = [0], [0], threading.Lock()

    def run(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        return x
    assert S.submitted(spark, SMALL, range(4), run) == [0, 1, 2, 3] and most[0] > 1
    most[0] = 0
    monkeypatch.setattr(S, "LARGE", 1)
    assert S.submitted(spark, SMALL, range(4), run) == [0, 1, 2, 3] and most[0] == 1


def test_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    makers = (X.raw_orders, X.raw_order_items, X.raw_picker_activity, X.raw_substitutions)
    t = _inputs(spark)
    want = {fn: _rows(fn(t)) for fn in makers}
    parents = {"order_id": spark.createDataFrame([("ORD_00000001",), ("ORD_00000002",)], "order_id string"),
               "picker_id": spark.createDataFrame([("PKR_0007",), ("PKR_0008",)], "picker_id string")}
    checked = _rows(C.clean_picker_activity(X.picker_activity_lines(t), parents["picker_id"])[0])
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    for fn in makers:
        df = fn(t).agg(F.count(F.lit(1)))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert _rows(fn(t)) == want[fn]
    df = C.clean_picker_activity(X.picker_activity_lines(t), parents["picker_id"])[0]
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString() and _rows(df) == checked


def test_duplicates_shuffle_digests_and_repeated_rows_alone(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}", None) for i in range(50)] + [(1, "text 1", None), (1, "text 1", None), (2, "text 2", None), (None, None, None)]
    spark.createDataFrame(rows, "a int, b string, c date").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for most, join in ((X.BROADCAST_ROWS, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(X, "BROADCAST_ROWS", most)
        out = profile_duplicates(df, "t")
        plan = out._jdf.queryExecution().executedPlan().toString()
        # few rows pass the broadcast digests before any shuffle; where they were shuffled to meet these, groups need none of their own
        assert join in plan and plan.count("Exchange hashpartitioning(") == 2
        assert [tuple(r) for r in out.collect()] == [("t", 54, 51, 3)]


def test_raw_csv_is_compressed(spark, monkeypatch, request):
    monkeypatch.setenv("STOREPULSE_NAMESPACE", f"test-{request.node.name}-{os.getpid()}")
    out = _rows(E.queries()["csv_source"](spark, SMALL))
    base = S._published(spark, f"{S._root(spark, SMALL)}/csv_source.current")
    files = [n for _, _, names in os.walk(base.removeprefix("file:")) for n in names if n.startswith("part-")]
    assert out and files and all(n.endswith(".csv.gz") for n in files)
