"""Mergeable bitmaps and stored summaries."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from storepulse.operators.distinct import bucket_count, distinct_counts, member_bitmaps
from storepulse.plans import explore, pnl, products, reports, sla
from storepulse.plans.operator_queries import agg_count_distinct
from storepulse.plans.summaries import BUILDERS, TableSet, summary, whole_months
from storepulse.plans.tableset import clean_tables
from storepulse.sources.tables import write_table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("buckets", [1, 4])
@pytest.mark.parametrize("home", [None, "s"])
def test_bitmaps_count_what_count_distinct_counts(spark, buckets, home):
    """Null keys and groups, keys in several groups and homes, a group with most rows, repeated rows."""
    rng = random.Random(buckets)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y", None]), rng.choice([None, *map(str, range(300))])) for _ in range(3000)]
    df = spark.createDataFrame(data, "s string, c string, k string").repartition(3)
    kept = member_bitmaps(df, ["s", "c"], "k", home, buckets)
    for groups in (["s", "c"], ["s"], ["c"], []):
        want = df.where("k is not null").groupBy(*groups).agg(F.countDistinct("k").alias("n"))
        assert rows(distinct_counts(kept, groups, "n")) == rows(want)


def test_more_keys_than_a_bitmap_holds(spark):
    df = spark.range(70_000).select(F.lit("s").alias("s"), F.col("id").alias("k"))
    kept = member_bitmaps(df, ["s"], "k")
    assert kept.count() == 3 and distinct_counts(kept, ["s"]).first()["distinct_keys"] == 70_000
    assert distinct_counts(kept, []).first()["distinct_keys"] == 70_000


def test_buckets_follow_the_largest_home(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("s"), F.col("id").alias("k"))
    assert 8 <= bucket_count(df, "k", "s", bucket=1000) <= 10
    assert bucket_count(df.where("false"), "k", "s") == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "s string, k string")
    kept = member_bitmaps(df, ["s"], "k", "s")
    assert distinct_counts(kept, ["s"]).collect() == []
    assert distinct_counts(kept, []).first()["distinct_keys"] == 0


def test_distinct_counts_exchange_no_orders(spark):
    T = clean_tables(spark, SMALL)
    for fn in (products.category_by_store, products.category_summary, agg_count_distinct):
        p = plan(fn(T))
        exchanges = [line for line in p.splitlines() if "Exchange hashpartitioning" in line]
        assert exchanges and not any("order_id" in e or "customer_id" in e for e in exchanges)


def test_stored_summaries_equal_those_of_the_facts(spark):
    T = clean_tables(spark, SMALL)
    assert isinstance(T, TableSet)
    for name in ("minute_counts", "hour_counts", "store_months"):
        assert rows(summary(T, name)) == rows(BUILDERS[name](dict(T)).select(*summary(T, name).columns))
    for fn in (sla.delivery_percentiles, sla.delivery_summary, reports.hourly_peak_bands, products.category_by_store, agg_count_distinct):
        assert rows(fn(T)) == rows(fn(dict(T)))


def test_findings_read_no_orders(spark):
    T = clean_tables(spark, SMALL)
    for fn in (reports.key_findings, explore.eda_findings, pnl.store_pnl_summary, reports.sla_bands, explore.store_pnl_estimate):
        assert not any("/fact_orders" in f for f in fn(T).inputFiles())
    assert rows(explore.eda_findings(T)) == rows(explore.eda_findings(dict(T)))


def test_a_store_slice_skips_rows_of_its_months(spark, tmp_path):
    """One month of many stores: files are sorted by store, so a reader of one store skips most pages."""
    df = spark.range(0, 300_000, 1, 4).select(
        F.format_string("STR_%03d", F.col("id") * 7919 % 25).alias("store_id"), F.col("id").cast("string").alias("order_id"),
        F.lit("1997-05-05").cast("date").alias("order_date"), F.md5(F.col("id").cast("string")).alias("note"))
    write_table(df, str(tmp_path / "t"), "fact_test")
    back = spark.read.parquet(str(tmp_path / "t")).where("store_id = 'STR_003'").select("order_id", "store_id")
    read = back.collect()
    assert len(read) == 12_000
    node = back._jdf.queryExecution().executedPlan()
    node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
    leaf = node.collectLeaves().head()
    assert leaf.metrics().apply("numOutputRows").value() < 100_000
    cells = {r.order_month for r in spark.read.parquet(str(tmp_path / "t")).select("order_month").distinct().collect()}
    assert cells == {"1997-05"}


def test_a_slice_of_whole_months_reads_no_facts(spark):
    T = clean_tables(spark, SMALL)
    cut = reports.apply_slicers(T, city="Asia", date_from="1995-04-01", date_to="1996-09-30")
    for fn in (sla.delivery_percentiles, sla.delivery_summary, reports.hourly_peak_bands):
        files = fn(cut).inputFiles()
        assert any("_counts" in f for f in files) and not any("/fact_" in f for f in files)
        assert rows(fn(cut)) == rows(fn(dict(cut)))


def test_a_slice_within_a_month_reads_the_facts(spark):
    T = clean_tables(spark, SMALL)
    cut = reports.apply_slicers(T, date_from="1995-04-02", date_to="1996-09-30")
    assert any("/fact_orders" in f for f in sla.delivery_percentiles(cut).inputFiles())
    assert rows(sla.delivery_percentiles(cut)) == rows(sla.delivery_percentiles(dict(cut)))
    store = reports.apply_slicers(T, store="STR_003")
    assert rows(products.category_by_store(store)) == rows(products.category_by_store(dict(store)))


def test_whole_months():
    assert whole_months(None, None) and whole_months("1996-02-01", "1996-02-29") and whole_months(None, "1995-12-31")
    assert not whole_months("1996-02-02", None) and not whole_months(None, "1996-02-28")
