"""Properties on the derived tables (sf0.001)."""

from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SMALL
from storepulse.operators import mutations as M
from storepulse.plans import pnl, reports, sla, substitutions
from storepulse.plans.operator_queries import QUERIES as OPQ


def test_shares_sum_to_100(small_tables):
    _, T = small_tables
    for df in (sla.sla_share(T), sla.profitable_share(T), reports.order_status_share(T),
               substitutions.substitution_share(T)):
        assert abs(df.agg(F.sum("pct")).collect()[0][0] - 100.0) <= 0.15


def test_rows_before_equal_after_plus_removed(spark):
    for r in OPQ["rows_before_after"](spark, SMALL).collect():
        assert r.rows_before == r.rows_after + r.rows_removed and r.rows_removed >= 0


def test_audit_counts_equal_anti_join_counts(spark, small_tables):
    raw, T = small_tables
    audit = {(r.table, r.issue_found): r.rows_affected for r in T["cleaning_audit"].collect()}
    items_ok = raw["fact_order_items"].filter("quantity > 0 AND unit_price_inr > 0")
    orphans = items_ok.join(T["fact_orders"].select("order_id"), "order_id", "left_anti").count()
    assert audit.get(("fact_order_items", "Orphan items"), 0) == orphans
    dup = raw["fact_orders"].count() - raw["fact_orders"].select("order_id").distinct().count()
    assert audit[("fact_orders", "Duplicate order ids")] == dup


def test_cleaning_is_idempotent_on_stores_and_skus(small_tables):
    from storepulse.operators.cleaning import clean_skus, clean_stores
    _, T = small_tables
    s = T["dim_stores"].drop("store_age_days", "cost_per_sqft")
    again, _ = clean_stores(s)
    assert again.count() == T["dim_stores"].count()
    k = T["dim_skus"].drop("gross_margin_pct_actual", "is_high_margin")
    again, audit = clean_skus(k)
    assert again.count() == T["dim_skus"].count()
    assert {r.issue_found for r in audit.collect()} == {"Derived columns"}


def test_update_script_counts(small_tables):
    _, T = small_tables
    o = T["fact_orders"]
    n = o.count()
    s = M.sample_exact_fraction(o)
    assert s.filter("repriced").count() == int((Decimal(n) * Decimal("0.12")).quantize(Decimal(1), "ROUND_HALF_UP"))
    rep = s.filter("repriced").collect()
    assert all(r.gross_profit_inr == r.net_order_value_inr - r.delivery_cost_inr for r in rep)
    f = M.stratified_flag(o)
    per = {r.store_id: (r.n, r.met) for r in f.filter("order_status = 'Delivered'").groupBy("store_id")
           .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("sla_met").cast("int")).alias("met")).collect()}
    for store, (total, met) in per.items():
        rate = Decimal(M.STORE_SLA_RATES.get(store, "0"))
        assert met == int(Decimal(total) * rate)
    assert f.filter("order_status <> 'Delivered' AND sla_met").count() == 0


def test_break_even_equals_naive_fanout(small_tables):
    _, T = small_tables
    d = T["fact_orders"].filter("order_status = 'Delivered'")
    daily = d.groupBy("store_id", "order_date").agg(F.count(F.lit(1)).alias("daily"))
    naive = d.join(daily, "store_id").groupBy("store_id").agg(
        (F.sum(F.col("gross_profit_inr").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("gp"),
        (F.sum("daily").cast("double") / F.count(F.lit(1))).alias("dd"))
    got = {r.store_id: r for r in pnl.break_even(T).collect()}
    for r in naive.collect():
        assert round(r.gp, 2) == got[r.store_id].avg_profit_per_order
        assert round(r.dd) == got[r.store_id].actual_avg_daily_orders
