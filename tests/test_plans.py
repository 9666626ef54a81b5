"""Plan-shape guards: the properties the scale design relies on."""

import pytest

import os
import subprocess
import sys

import __spark_entry__ as E
from conftest import ROOT, SMALL
from storepulse.plans.registry import queries

KEYS = sorted(queries())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_no_python_udf(spark, key):
    p = _plan(E.queries()[key](spark, SMALL))
    assert "CartesianProduct" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_report_query_pushes_filter_and_prunes_columns(spark):
    df = E.queries()["sla_by_store"](spark, SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(order_status), EqualTo(order_status,Delivered)" in p
    assert "ReadSchema: struct<order_id:string,store_id:string,pick_time_mins" in p
    assert "customer_id" not in p.split("ReadSchema")[1].split("\n")[0]   # unused columns pruned


def test_store_dimension_is_broadcast_after_aggregation(spark):
    p = _plan(E.queries()["store_scorecard"](spark, SMALL))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_csv_roundtrip_with_explicit_schema(spark, small_tables, tmp_path):
    from storepulse.sources.tables import read_table
    _, T = small_tables
    out = str(tmp_path / "orders_csv")
    T["fact_orders"].drop("gross_profit_inr", "is_profitable", "order_hour_band", "delivery_speed_band", "order_month") \
        .write.option("header", True).csv(out)
    back = read_table(spark, out, "fact_orders", fmt="csv")
    assert back.schema == __import__("storepulse.sources.schemas", fromlist=["ORDERS"]).ORDERS
    assert back.count() == T["fact_orders"].count()
    assert back.exceptAll(T["fact_orders"].select(*back.columns)).count() == 0


def test_sql_over_registered_views_matches_dataframe_plan(spark, small_tables):
    """IO4/IO5: the cleaned tables as views; SQL text gives the same answer."""
    from storepulse.plans import sla
    from storepulse.sources.tables import register_views
    _, T = small_tables
    register_views({k: v for k, v in T.items()})
    got = spark.sql("""
        SELECT s.store_id, COUNT(o.order_id) AS total_orders,
               CAST(ROUND(CAST(CAST(SUM(CASE WHEN o.sla_met THEN 1 ELSE 0 END) AS DOUBLE) * 100.0
                    / COUNT(o.order_id) AS DECIMAL(28,10)), 1) AS DOUBLE) AS sla_pct
        FROM fact_orders o JOIN dim_stores s ON o.store_id = s.store_id
        WHERE o.order_status = 'Delivered' GROUP BY s.store_id""")
    want = sla.sla_pct_by_store(T).select("store_id", "sla_pct")
    assert sorted((r.store_id, r.sla_pct) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_concurrent_builders_publish_complete_sets(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from storepulse.plans.tableset import _publish, _published
    final = str(tmp_path / "set")

    def build(base):
        spark.range(10).write.parquet(f"{base}/stage/t")
        spark.range(100).write.mode("overwrite").parquet(f"{base}/t")

    with ThreadPoolExecutor(max_workers=2) as pool:
        paths = list(pool.map(lambda _: _publish(spark, final, build), range(2)))
    assert _published(spark, f"{final}.current") in paths
    for p in paths:                                         # every returned path is complete, without its stage
        assert spark.read.parquet(f"{p}/t").count() == 100
        assert not os.path.exists(f"{p}/stage")
    rebuilt = _publish(spark, final, lambda base: (_ for _ in ()).throw(AssertionError("rebuilt")))
    assert rebuilt in paths


def test_failed_build_is_not_published(spark, tmp_path):
    from storepulse.plans.tableset import _publish, _published
    final = str(tmp_path / "set")
    with pytest.raises(ZeroDivisionError):
        _publish(spark, final, lambda base: 1 / 0)
    assert _published(spark, f"{final}.current") is None


def test_entry_in_a_session_with_no_settings(tmp_path):
    """A fresh session, without any default settings, needs no set-up."""
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from pyspark.sql import SparkSession\n"
            f"spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
            f".config('spark.sql.warehouse.dir', {str(tmp_path / 'warehouse')!r}).getOrCreate()\n"
            "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
            "import __spark_entry__ as e\n"
            "print('ROWS', e.entry(spark).count())\n")
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith(("STOREPULSE_", "PYSPARK_SUBMIT"))}
    out = subprocess.run([sys.executable, "-c", code], env={**env, "SPARK_CONF_DIR": str(tmp_path / "conf")}, cwd=tmp_path,
                         capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def test_date_slice_reads_its_months_only(spark):
    p = _plan(E.queries()["slice_orders"](spark, SMALL))
    assert "PartitionFilters: [isnotnull(order_month" in p and "order_month#" in p.split("PartitionFilters: [isnotnull(order_month")[1][:300]


def test_a_large_month_is_written_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F
    from storepulse.sources.tables import write_table
    days = F.when(F.col("id") % 100 == 0, F.date_add(F.lit("1996-01-01").cast("date"), (F.col("id") % 700).cast("int"))) \
        .otherwise(F.lit("1997-05-05").cast("date"))
    df = spark.range(0, 400_000, 1, 8).select("id", days.alias("order_date"), F.md5(F.col("id").cast("string")).alias("order_id"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        write_table(df, str(tmp_path / "t"), "fact_test")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in os.listdir(tmp_path / "t" / "order_month=1997-05") if f.endswith(".parquet")]
    assert len(files) > 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 400_000


def test_key_ids_with_one_name_are_one_group(spark):
    from storepulse.plans.products import top_skus
    from storepulse.plans.substitutions import sku_stockout
    skus = spark.createDataFrame([("s1", "Milk", "Dairy", "A"), ("s2", "Milk", "Dairy", "A"), ("s3", "Oil", "Food", "B"),
                                  ("s4", None, "Food", "B")], "sku_id string, sku_name string, category string, velocity_class string")
    items = spark.createDataFrame([("o1", "s1", 1, 10.0, 1.0, 0.1), ("o1", "s2", 1, 20.0, 2.0, 0.1), ("o2", "s3", 1, 25.0, 2.0, 0.1),
                                   ("o3", "s4", 1, 5.0, 1.0, 0.2)],
                                  "order_id string, sku_id string, quantity int, item_total_inr double, item_margin_inr double, item_margin_pct double")
    top = [(r.sku_name, r.orders_containing_sku, r.total_revenue, r.revenue_rank)
           for r in top_skus({"fact_order_items": items, "dim_skus": skus}).collect()]
    assert sorted(top, key=str) == sorted([("Milk", 1, 30.0, 1), ("Oil", 1, 25.0, 2), (None, 1, 5.0, 3)], key=str)
    subs = spark.createDataFrame([("a", "s1", True), ("b", "s2", False), ("c", "s3", True)],
                                 "substitution_id string, original_sku_id string, customer_accepted boolean")
    orders = spark.createDataFrame([("o1", "Delivered")], "order_id string, order_status string")
    out = sku_stockout({"fact_substitutions": subs, "dim_skus": skus, "fact_orders": orders}).collect()
    assert [(r.sku_name, r.times_substituted, r.rejection_rate_pct) for r in out] == [("Milk", 2, 50.0), ("Oil", 1, 0.0)]


def test_dedup_is_one_shuffle(spark):
    p = _plan(E.queries()["dedup_keep_first"](spark, SMALL))
    assert p.count("Exchange hashpartitioning") == 1 and p.count("FileScan") == 1


def test_exports_have_the_columns_and_order_of_the_reference(spark):
    from storepulse.plans.operator_queries import insights
    from storepulse.plans.tableset import clean_tables
    out = insights(clean_tables(spark, SMALL))
    assert out["03_store_pnl"].columns == ["store_name", "city", "avg_monthly_revenue", "avg_monthly_profit", "fixed_cost", "store_status"]
    assert out["05_picker_performance"].columns == ["picker_name", "skill_level", "shift", "store_name", "total_picks", "avg_pick_rate",
                                                    "total_errors", "error_rate_pct"]
    rates = [r.avg_pick_rate for r in out["05_picker_performance"].collect()]
    assert rates == sorted(rates, reverse=True)
    shares = [r.sla_pct for r in out["02_sla_by_store"].collect()]
    assert shares == sorted(shares)
