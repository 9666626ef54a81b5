"""Fact tables as narrow lines: what cleaning shuffles, and what it makes of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from storepulse.operators import cleaning as C
from storepulse.operators.distinct import SPREAD, member_bitmaps
from storepulse.sources import fixtures as X
from storepulse.sources import tables as IO


def _inputs(spark):
    day = datetime(1996, 3, 4)
    orders = spark.createDataFrame([(k, 1, "F", 100.0, day) for k in (1, 2, 3)] + [(None, 1, "F", 1.0, day)],
                                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz")
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"
    return {
        "orders": orders,
        "customer": spark.createDataFrame([(1, 4)], "c_custkey long, c_nationkey int"),
        "part": spark.createDataFrame([(1, "A", 5, 10.0), (0, "B", 6, 20.0)], "p_partkey long, p_type string, p_size int, p_retailprice double"),
        "supplier": spark.createDataFrame([(7, 2, 3000.0)], "s_suppkey long, s_nationkey int, s_acctbal double"),
        "lineitem": spark.createDataFrame([(1, 1, 7, 1, 2.0, "R", day), (1, 1, 7, 1, 2.0, "R", day), (2, 0, 7, 6, 3.0, "N", day),
                                           (9, 1, 7, 1, 2.0, "R", day), (None, 1, 7, 1, 2.0, "R", day), (3, 1, None, 1, 1.0, "R", day)], line),
    }


def _rows(df):
    return sorted(map(str, df.collect()))


def test_lines_clean_to_the_same_rows_as_raw_tables(spark):
    t = _inputs(spark)
    orders = spark.createDataFrame([("ORD_00000001",), ("ORD_00000002",)], "order_id string")
    pickers = spark.createDataFrame([("PKR_0007",)], "picker_id string")
    for lines, fn, parent in ((X.order_item_lines, C.clean_order_items, orders), (X.picker_activity_lines, C.clean_picker_activity, pickers),
                              (X.substitution_lines, C.clean_substitutions, orders)):
        plain, _ = fn(lines(t).df, parent)
        narrow, _ = fn(lines(t), parent)
        got = _rows(narrow.drop("order_month"))
        assert got == _rows(plain) and got
        assert {r[0] for r in narrow.select("order_month").collect()} == {"1996-03"}


def _stored(spark, tmp_path):
    def stage(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))
    return stage


def test_order_lines_clean_to_the_same_rows_as_raw_orders(spark, tmp_path):
    t = _inputs(spark)
    day = datetime(1996, 3, 4)
    # 500 arrives twice by rule; 7 is there three times with other values, 97 has a negative time, null keys group together
    more = [(500, 1, "F", 50.0, day), (7, 1, "F", 30.0, datetime(1996, 5, 6)), (7, 1, "O", 20.0, day), (7, 1, "F", 20.0, day),
            (97, 1, "P", 80.0, day), (211, 1, "F", 80.0, day), (403, 3, "F", 10.0, day), (None, 1, "F", 2.0, day), (8, 1, "F", 9.0, None)]
    t["orders"] = t["orders"].unionByName(spark.createDataFrame(more, t["orders"].schema))
    stores = spark.createDataFrame([("STR_005",)], "store_id string")
    plain, plain_audit = C.clean_orders(X.raw_orders(t), stores)
    narrow, audit = C.clean_orders(X.order_lines(t), stores, observe=True, persist=_stored(spark, tmp_path))
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    got = _rows(narrow.select(*plain.columns))
    assert got == _rows(plain) and len({r.order_id for r in plain.collect()}) >= 6
    assert sorted(audit.rows()) == sorted(map(tuple, plain_audit.collect()))
    # columns are worked out above the only shuffle, which carries narrow rows
    assert plan.index("CUST_") < plan.index("Exchange hashpartitioning(order_month") and plan.count("Exchange hashpartitioning(") == 1
    assert set(spark.read.parquet(str(tmp_path / "fact_orders__dedup")).columns) == \
        {*X.order_keys(t).columns, "_store_ok", "_dups"}


def test_order_keys_of_items_are_shuffled_once(spark):
    """The join with orders and the check of their key share one shuffle; the month's shuffle carries no ids."""
    orders = spark.createDataFrame([("ORD_00000001",)], "order_id string")
    df, _ = C.clean_order_items(X.order_item_lines(_inputs(spark)), orders)
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = [s for s in plan.splitlines() if "Exchange hashpartitioning(" in s]
    assert sum("hashpartitioning(order_id" in s for s in exchanges) == 1
    assert any("order_month" in s for s in exchanges)
    assert plan.index("ITM") < plan.index("Exchange hashpartitioning(order_month")     # worked out above the shuffle


def test_compressed_csv_is_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IO, "CSV_ROWS", 10)
    df = spark.range(25).coalesce(1).select(F.concat(F.lit("c"), "id").alias("a"), F.col("id").cast("int").alias("b"))
    IO.write_table(df, str(tmp_path / "t"), "dim_test", "csv", compression="gzip")
    files = [f.name for f in (tmp_path / "t").iterdir() if f.name.startswith("part-")]
    assert len(files) == 3 and all(f.endswith(".csv.gz") for f in files)
    assert _rows(spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "t"))) == _rows(df)


def test_bitmap_buckets_have_partitions_of_their_own(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit("s").alias("s"))
    plan = member_bitmaps(df, ["s"], "k", "s", 6)._jdf.queryExecution().executedPlan().toString()
    assert f", {SPREAD * 6}), REPARTITION_BY_NUM" in plan
