"""Registered keys for the generic operators, cleaning, profiling, column
rewrites, feature derivations and IO — each a direct use of the operator on
the derived tables, over whole tables.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from storepulse.functions.exprs import exact_mean, exact_round, month_start, rate_pct, safe_div
from storepulse.operators import features as X
from storepulse.operators import mutations as M
from storepulse.operators import profiling as D
from storepulse.operators.distinct import distinct_counts
from storepulse.operators.ranking import join_null_safe
from storepulse.operators.cleaning import _keep_first
from storepulse.plans.common import delivered, rank_desc, store_dim
from storepulse.plans import sla
from storepulse.plans.sla import time_band
from storepulse.plans.summaries import summary
from storepulse.sources import tables as IO
from storepulse.plans.tableset import clean_set, clean_tables, published, raw_read_once, raw_table_set as raw_tables, submitted, updated_tables
from storepulse.sources.schemas import TABLE_NAMES


def _clean(spark, sf_dir):
    return clean_set(spark, sf_dir)


# ---------------------------------------------------------------- predicates

def filter_delivered(T):
    return delivered(T["fact_orders"]).select("order_id", "store_id", "order_date", "net_order_value_inr",
                                              "total_delivery_mins")


def filter_comparison(T):
    o = T["fact_orders"]
    return o.filter((F.col("total_delivery_mins") > 10) & (F.col("net_order_value_inr") >= 100000)
                    & (F.col("order_hour") < 12) & (F.col("payment_method") != "COD")
                    & (F.col("num_items") <= 6)) \
        .select("order_id", "total_delivery_mins", "net_order_value_inr", "order_hour", "payment_method",
                "num_items")


def filter_between(T):
    """Inclusive range and its null-safe negation (null is out of range)."""
    r = F.col("customer_rating").between(2, 4)
    return T["fact_orders"].select(
        "order_id", "customer_rating", "total_delivery_mins", r.alias("rating_2_to_4"),
        (~F.coalesce(r, F.lit(False))).alias("rating_outside_2_to_4"),
        F.col("total_delivery_mins").between(8, 10).alias("minutes_8_to_10"))


def filter_isin(T):
    o = T["fact_orders"]
    return o.filter(F.col("payment_method").isin("UPI", "Card") & ~F.col("order_status").isin("RTO")) \
        .select("order_id", "payment_method", "order_status")


def case_when_flags(T):
    v = F.col("net_order_value_inr")
    return T["fact_orders"].select(
        "order_id",
        F.when(F.col("sla_met"), "SLA Met").otherwise("SLA Breached").alias("sla_status"),
        time_band("order_hour").alias("time_band"),
        F.when(v >= 300000, "high").when(v >= 100000, "mid").otherwise("low").alias("value_tier"))


# ---------------------------------------------------------------- joins

def join_inner_store(T):
    return T["fact_orders"].select("order_id", "store_id", "net_order_value_inr") \
        .join(store_dim(T, "store_name", "city"), "store_id")


def join_inner_multi(T):
    a = T["fact_picker_activity"].select("activity_id", "picker_id", "store_id", "pick_rate_per_min")
    return (a.join(T["dim_pickers"].select("picker_id", "picker_name", "skill_level"), "picker_id")
             .join(store_dim(T, "store_name"), "store_id")
             .select("activity_id", "picker_name", "skill_level", "store_name", "pick_rate_per_min"))


def join_left_enrich(T):
    """Left enrich with colliding columns: the dimension's copies get a suffix."""
    a = T["fact_picker_activity"].select("activity_id", "picker_id", "store_id", "shift")
    p = T["dim_pickers"].select("picker_id", F.col("store_id").alias("store_id_picker"),
                                F.col("shift").alias("shift_picker"), "skill_level")
    return a.join(p, "picker_id", "left").join(store_dim(T, "store_name", "city"), "store_id", "left")


def semi_join_fk(raw, T):
    return raw["fact_order_items"].join(T["fact_orders"].select("order_id"), "order_id", "left_semi") \
        .select("item_id", "order_id")


def anti_join_orphans(raw, T):
    return raw["fact_order_items"].join(T["fact_orders"].select("order_id"), "order_id", "left_anti") \
        .select("item_id", "order_id")


def cross_join_scalar(T):
    d = delivered(T["fact_orders"])
    per = d.groupBy("store_id").agg(F.count(F.lit(1)).alias("orders"))
    net = d.agg(F.count(F.lit(1)).alias("network_orders"))          # one row
    return per.crossJoin(F.broadcast(net)).withColumn(
        "share_pct", exact_round(safe_div(F.col("orders") * 100, "network_orders"), 2))


def semi_join_subquery(T, min_orders: int = 20):
    """Orders of customers with at least ``min_orders`` Delivered orders (IN subquery → semi join)."""
    heavy = delivered(T["fact_orders"]).groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n")) \
        .filter(F.col("_n") >= min_orders).select("customer_id")
    return T["fact_orders"].join(heavy, "customer_id", "left_semi").select("order_id", "customer_id", "order_status")


# ---------------------------------------------------------------- aggregation

def agg_basic(T):
    t = F.col("total_delivery_mins")
    return T["fact_orders"].groupBy("store_id", "order_status").agg(
        F.count("order_id").alias("orders"), exact_round(F.sum("net_order_value_inr"), 2).alias("revenue"),
        exact_round(exact_mean(t), 2).alias("avg_minutes"), F.min(t).cast("double").alias("min_minutes"),
        F.max(t).cast("double").alias("max_minutes"))


def agg_conditional_rate(T):
    return T["fact_orders"].groupBy("store_id").agg(
        exact_round(rate_pct(F.col("sla_met")), 2).alias("sla_pct"),
        exact_round(rate_pct(F.col("is_profitable")), 2).alias("profitable_pct"),
        exact_round(rate_pct(F.col("is_weekend")), 2).alias("weekend_pct"),
        exact_round(rate_pct(F.col("order_status") == "Cancelled"), 2).alias("cancelled_pct"))


def agg_count_distinct(T):
    """Exact distinct counts: customers from stored bitmaps, days and payment methods from their own combinations."""
    by = ["store_id"]
    days = T["fact_orders"].groupBy("store_id", "order_date", "payment_method").agg(F.count(F.lit(1)).alias("_n"))
    days = days.groupBy("store_id").agg(F.countDistinct("order_date").alias("distinct_days"),
                                        F.countDistinct("payment_method").alias("distinct_payment_methods"))
    customers = distinct_counts(summary(T, "customer_bitmaps"), by, "distinct_customers")
    return join_null_safe(days, customers, by, "left").withColumn("distinct_customers", F.coalesce("distinct_customers", F.lit(0).cast("long")))


def agg_two_level(T):
    m = T["fact_orders"].groupBy("store_id", month_start("order_date").alias("month")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    return m.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("months"), exact_round(exact_mean("_n", 0), 1).alias("avg_monthly_orders"),
        F.max("_n").alias("max_monthly_orders"))


def status_counts(T):
    return T["fact_orders"].groupBy("order_status").agg(F.count(F.lit(1)).alias("row_count"))


def window_rank(T):
    r = delivered(T["fact_orders"]).groupBy("store_id").agg(F.sum("net_order_value_inr").alias("_rev"))
    return r.select("store_id", exact_round("_rev", 0).alias("total_revenue"),
                    rank_desc("_rev").alias("revenue_rank"))


def dedup_keep_first(raw):
    o = raw["fact_orders"]
    order = ["order_timestamp"] + [c for c in o.columns if c not in ("order_id", "order_timestamp")]
    return _keep_first(o, ["order_id"], order).drop("_dups")


# ---------------------------------------------------------------- cleaning

CLEAN_KEYS = {
    "clean_stores": "dim_stores", "clean_skus": "dim_skus", "clean_customers": "dim_customers",
    "clean_pickers": "dim_pickers", "clean_orders": "fact_orders", "clean_order_items": "fact_order_items",
    "clean_picker_activity": "fact_picker_activity", "clean_substitutions": "fact_substitutions",
}


def rows_before_after(raw, T):
    parts = []
    for t in TABLE_NAMES:
        b = raw[t].agg(F.count(F.lit(1)).alias("rows_before"))
        a = T[t].agg(F.count(F.lit(1)).alias("rows_after"),
                     *([exact_round(rate_pct(F.col("sla_met")), 1).alias("sla_met_pct"),
                        exact_round(rate_pct(F.col("is_profitable")), 1).alias("profitable_pct")]
                       if t == "fact_orders" else
                       [F.lit(None).cast("double").alias("sla_met_pct"),
                        F.lit(None).cast("double").alias("profitable_pct")]))
        parts.append(b.crossJoin(a).select(F.lit(t).alias("table_name"), "rows_before", "rows_after",
                                           (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
                                           "sla_met_pct", "profitable_pct"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- IO

def _plain_text(c: str, dtype: str):
    """A value as text that does not depend on the engine."""
    col = F.col(c)
    if dtype == "double":
        return col.cast("decimal(28,6)").cast("string")
    if dtype.startswith("timestamp"):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return col.cast("string")


def checksums(df, source: str, name: str):
    """Per column: rows, non-null values and an order-free checksum of them.  One pass."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (c, dtype) in enumerate(df.dtypes):
        digest = F.conv(F.substring(F.md5(_plain_text(c, dtype)), 1, 8), 16, 10).cast("bigint")
        aggs += [F.count(c).alias(f"_n{i}"), F.coalesce(F.sum(digest), F.lit(0)).alias(f"_s{i}")]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("non_null"), F.col(f"_s{i}").alias("checksum"))
                      for i, c in enumerate(df.columns)])
    return df.agg(*aggs).select(F.lit(source).alias("source"), F.lit(name).alias("table_name"), "rows", F.inline(cells))


def _all(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def sink_roundtrip(spark, sf_dir):
    """The eight cleaned tables and the audit, written as Parquet (facts by order month) and as
    headed CSV (gzip), read back with their schemas: checksums of every column."""
    T = clean_tables(spark, sf_dir)

    def build(base):
        for name, df in T.items():
            for fmt in ("parquet", "csv"):
                IO.write_table(df, f"{base}/{fmt}/{name}", name, fmt, compression="gzip" if fmt == "csv" else "zstd")

    base = published(spark, sf_dir, "sink_roundtrip", build)
    return _all([checksums(IO.read_table(spark, f"{base}/{fmt}/{name}", name, fmt, clean=True), fmt, name)
                 for fmt in ("parquet", "csv") for name in T])


def csv_source(spark, sf_dir):
    """The eight raw tables read from headed CSV files (gzip) with their explicit schemas."""
    def build(base):
        raw = raw_read_once(spark, sf_dir, stage=True)
        submitted(spark, sf_dir, TABLE_NAMES, lambda name: IO.write_table(raw[name], f"{base}/{name}", name, "csv", compression="gzip"))

    base = published(spark, sf_dir, "csv_source", build)
    return _all([checksums(IO.read_table(spark, f"{base}/{name}", name, "csv"), "csv", name) for name in TABLE_NAMES])


def insights(T):
    """The seven exported insight tables, with the columns and order of the reference."""
    from storepulse.plans import pnl, pickers, products, substitutions as SB
    from storepulse.plans.reports import _hourly, _sla_slim
    sc = pnl.scorecard_export(T).withColumnRenamed("network_sla_share_pct", "sla_pct")
    return {
        "01_store_scorecard": sc.orderBy(F.col("revenue_lac").desc(), "store_name").select(
            "store_name", "city", "total_orders", "revenue_lac", "avg_delivery_mins", "sla_pct", "avg_profit_per_order"),
        "02_sla_by_store": _sla_slim(T).orderBy("sla_pct", "store_name").select(
            "store_name", "city", "total_orders", "avg_delivery_mins", "avg_pick_mins", "avg_travel_mins", "sla_pct"),
        "03_store_pnl": pnl.store_pnl_summary(T).orderBy(F.col("avg_monthly_profit").desc(), "store_name").select(
            "store_name", "city", "avg_monthly_revenue", "avg_monthly_profit", "fixed_cost", "store_status"),
        "04_category_performance": products.category_performance(T).orderBy(F.col("total_revenue").desc(), "category").select(
            "category", "total_qty", "total_revenue", "total_margin", "avg_margin_pct"),
        "05_picker_performance": pickers.picker_productivity(T, with_rank=False).orderBy(F.col("avg_pick_rate").desc(), "picker_id")
        .select("picker_name", "skill_level", "shift", "store_name", "total_picks", "avg_pick_rate", "total_errors", "error_rate_pct"),
        "06_substitution_analysis": SB.substitution_bands(T)
        .orderBy(F.col("acceptance_rate_pct").desc(), "original_category", "same_category", "reason_for_sub")
        .select("original_category", "same_category", "reason_for_sub", "total_subs", "acceptance_rate_pct"),
        "07_hourly_demand": _hourly(T).orderBy("order_hour").select("order_hour", "total_orders", "avg_delivery_mins", "sla_pct"),
    }


def insights_export(spark, sf_dir):
    """Export the seven insight tables as CSV; checksums of every column read back."""
    results = insights(clean_set(spark, sf_dir))
    base = published(spark, sf_dir, "insights", lambda folder: IO.export_results(results, folder))
    return _all([checksums(spark.read.schema(df.schema).option("header", True).csv(f"{base}/{name}"), "csv", name)
                 for name, df in results.items()])


# ---------------------------------------------------------------- registry

def _eight(T):
    return {t: T[t] for t in TABLE_NAMES}


def _c(fn):
    return lambda spark, sf: fn(_clean(spark, sf))


def _rc(fn, names=tuple(TABLE_NAMES)):
    """A query on the cleaned tables and raw ones, each of which it reads once."""
    return lambda spark, sf: fn(raw_read_once(spark, sf, names), _clean(spark, sf))


def _r(fn, names):
    return lambda spark, sf: fn(raw_tables(spark, sf, names=names))


def _o(fn):
    return lambda spark, sf: fn(_clean(spark, sf)["fact_orders"])


def _m2(o):
    return M.recompute_total(o).select("order_id", *M.TIME_COLS, "total_delivery_mins")


def _m3(o):
    return M.recompute_sla(M.recompute_total(o)).select("order_id", "total_delivery_mins", "sla_met")


def _m4(o):
    return M.recompute_profit(o).select("order_id", "net_order_value_inr", "delivery_cost_inr", "gross_profit_inr")


def _m5(o):
    return M.recompute_profitable(M.recompute_profit(o)).select("order_id", "gross_profit_inr", "is_profitable")


def _m6(o):
    o = M.recompute_profitable(M.recompute_profit(M.recompute_sla(M.recompute_total(o))))
    return M.sample_exact_fraction(o).select("order_id", "delivery_cost_inr", "gross_profit_inr", "is_profitable", "repriced")


def _updated(fn):
    """A query on the tables as the update script leaves them."""
    return lambda spark, sf: fn(updated_tables(spark, sf))


QUERIES = {
    "filter_delivered": _c(filter_delivered),
    "filter_comparison": _c(filter_comparison),
    "filter_between": _c(filter_between),
    "filter_isin": _c(filter_isin),
    "case_when_flags": _c(case_when_flags),
    "join_inner_store": _c(join_inner_store),
    "join_inner_multi": _c(join_inner_multi),
    "join_left_enrich": _c(join_left_enrich),
    "semi_join_fk": _rc(semi_join_fk, ["fact_order_items"]),
    "anti_join_orphans": _rc(anti_join_orphans, ["fact_order_items"]),
    "cross_join_scalar": _c(cross_join_scalar),
    "semi_join_subquery": _c(semi_join_subquery),
    "agg_basic": _c(agg_basic),
    "agg_conditional_rate": _c(agg_conditional_rate),
    "agg_count_distinct": _c(agg_count_distinct),
    "agg_two_level": _c(agg_two_level),
    "status_counts": _c(status_counts),
    "describe_numeric": lambda s, d: D.profile_tables(raw_tables(s, d, numeric=True), D.describe_numeric),
    "window_rank": _c(window_rank),
    "dedup_keep_first": _r(dedup_keep_first, ["fact_orders"]),
    "table_row_counts": lambda s, d: IO.table_row_counts(_eight(clean_tables(s, d))),
    "profile_nulls": lambda s, d: D.profile_tables(raw_tables(s, d), D.profile_nulls),
    "profile_duplicates": lambda s, d: D.profile_tables(raw_tables(s, d), D.profile_duplicates),
    "table_shape": lambda s, d: D.profile_tables(raw_tables(s, d), D.table_shape),
    "duplicate_key_count": lambda s, d: _dup_keys(raw_tables(s, d)),
    "order_calendar_features": _o(X.order_calendar_features),
    "order_value_build": _o(X.order_value_build),
    "pick_activity_build": _c(lambda T: X.pick_activity_build(T["fact_picker_activity"], T["dim_pickers"])),
    "substitution_pairs": _c(lambda T: X.substitution_pairs(T["fact_substitutions"], T["dim_skus"])),
    "item_economics": _c(lambda T: X.item_economics(T["fact_order_items"], T["dim_skus"])),
    "recompute_total": _o(_m2),
    "recompute_sla": _o(_m3),
    "recompute_profit": _o(_m4),
    "recompute_profitable": _o(_m5),
    "sample_exact_fraction": _o(_m6),
    "stratified_flag": _updated(lambda T: T["fact_orders"].select("order_id", "store_id", "order_status", "sla_met")),
    "sla_share_updated": _updated(sla.sla_share),
    "profitable_share_updated": _updated(sla.profitable_share),
    "delivery_summary_updated": _updated(sla.delivery_summary),
    "sla_pct_by_store_updated": _updated(sla.sla_pct_by_store),
    "cleaning_audit": lambda s, d: _clean(s, d)["cleaning_audit"],
    "rows_before_after": lambda s, d: rows_before_after(raw_read_once(s, d), clean_tables(s, d)),
    "sink_roundtrip": sink_roundtrip,
    "csv_source": csv_source,
    "insights_export": insights_export,
}
for _k, _t in CLEAN_KEYS.items():
    QUERIES[_k] = (lambda t: (lambda s, d: _clean(s, d)[t].drop("order_month")))(_t)

DUP_KEYS = {
    "dim_stores": ["store_id"], "dim_skus": ["sku_id"], "dim_customers": ["email"], "dim_pickers": ["picker_id"],
    "fact_orders": ["order_id"], "fact_order_items": ["item_id"], "fact_picker_activity": ["activity_id"],
    "fact_substitutions": ["substitution_id"],
}


def _dup_keys(raw):
    return D.profile_tables({t: raw[t] for t in DUP_KEYS}, lambda df, name: D.duplicate_key_count(df, name, DUP_KEYS[name]))
