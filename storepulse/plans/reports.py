"""Report-level operators: KPI tiles, status counts, colour bands, findings,
dashboard visuals and slicers — every decision a report paints, as columns.

All inputs here are store-, hour-, picker- or category-sized aggregates;
one-row summaries are combined with broadcast cross joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.functions.exprs import exact_mean, exact_round, rate_pct, safe_div
from storepulse.plans.common import delivered, store_dim
from storepulse.plans.pnl import store_pnl_summary, store_scorecard
from storepulse.plans.pickers import picker_productivity
from storepulse.plans.products import category_performance
from storepulse.plans.substitutions import substitution_bands
from storepulse.plans.summaries import mean_of, sliced, summary

# fixed values: KPI and band thresholds
KPI_SLA_GREEN = 85.0
KPI_MINUTES_GREEN = 10.0
KPI_PROFITABLE_STORES_GREEN = 7
SLA_TARGET, SLA_WARNING = 88.0, 80.0
COMPOSITE_GREEN, COMPOSITE_AMBER = 3.0, 6.0


def _scorecard_with_aov(T: dict[str, DataFrame]) -> DataFrame:
    return store_scorecard(T).drop("revenue_rank", "sla_rank", "profit_rank")


def executive_kpis(T: dict[str, DataFrame]) -> DataFrame:
    """KPI tiles in long form: (kpi, value, status).  A status judges the unrounded mean."""
    sc = _scorecard_with_aov(T).agg(
        exact_round(F.sum("revenue_lac"), 1).alias("total_revenue_lakh"),
        F.sum("total_orders").cast("double").alias("total_orders"),
        F.avg("sla_pct").alias("_sla"), F.avg("avg_delivery_mins").alias("_mins"),
        exact_round(F.avg("avg_order_value"), 0).alias("avg_order_value"))
    pnl = store_pnl_summary(T).agg(
        F.sum(F.when(F.col("store_status") == "PROFITABLE", 1).otherwise(0)).cast("double")
        .alias("profitable_stores"))
    j = sc.crossJoin(pnl)
    tiles = F.array(
        F.struct(F.lit("total_revenue_lakh").alias("kpi"), F.col("total_revenue_lakh").alias("value"),
                 F.lit("info").alias("status")),
        F.struct(F.lit("total_orders").alias("kpi"), F.col("total_orders").alias("value"),
                 F.lit("info").alias("status")),
        F.struct(F.lit("network_sla_pct").alias("kpi"), exact_round("_sla", 2).alias("value"),
                 F.when(F.col("_sla") >= KPI_SLA_GREEN, "green").otherwise("red").alias("status")),
        F.struct(F.lit("avg_delivery_mins").alias("kpi"), exact_round("_mins", 2).alias("value"),
                 F.when(F.col("_mins") <= KPI_MINUTES_GREEN, "green").otherwise("amber")
                 .alias("status")),
        F.struct(F.lit("avg_order_value").alias("kpi"), F.col("avg_order_value").alias("value"),
                 F.lit("info").alias("status")),
        F.struct(F.lit("profitable_stores").alias("kpi"), F.col("profitable_stores").alias("value"),
                 F.when(F.col("profitable_stores") >= KPI_PROFITABLE_STORES_GREEN, "green").otherwise("red")
                 .alias("status")))
    return j.select(F.inline(tiles))


def store_status_summary(T: dict[str, DataFrame]) -> DataFrame:
    return store_pnl_summary(T).groupBy("store_status").agg(F.count(F.lit(1)).alias("store_count"))


def _sla_band(c: str) -> F.Column:
    return F.when(F.col(c) >= SLA_TARGET, "green").when(F.col(c) >= SLA_WARNING, "amber").otherwise("red")


def scorecard_bands(T: dict[str, DataFrame]) -> DataFrame:
    s = F.col("composite_rank_score")
    return (_scorecard_with_aov(T)
            .withColumn("composite_band", F.when(s <= COMPOSITE_GREEN, "green")
                        .when(s <= COMPOSITE_AMBER, "amber").otherwise("red"))
            .withColumn("sla_band", _sla_band("sla_pct")))


def _sla_slim(T: dict[str, DataFrame]) -> DataFrame:
    """Delivered orders by store, from the stored sums."""
    agg = delivered(summary(T, "store_months")).groupBy("store_id").agg(
        F.sum("orders").cast("bigint").alias("total_orders"),
        exact_round(mean_of("minutes")).alias("avg_delivery_mins"),
        exact_round(mean_of("pick")).alias("avg_pick_mins"),
        exact_round(mean_of("travel")).alias("avg_travel_mins"),
        exact_round(safe_div(F.sum("met") * 100, F.sum("rows"))).alias("sla_pct"))
    return agg.join(store_dim(T, "store_name", "city"), "store_id")


def sla_bands(T: dict[str, DataFrame]) -> DataFrame:
    c = F.col("sla_pct")
    return _sla_slim(T).withColumn(
        "sla_status", F.when(c >= SLA_TARGET, "On Target").when(c >= SLA_WARNING, "Warning").otherwise("Critical"))


def _hourly(T: dict[str, DataFrame]) -> DataFrame:
    """Delivered orders by hour, from the stored counts."""
    return summary(T, "hour_counts").groupBy("order_hour").agg(
        F.sum("orders").cast("bigint").alias("total_orders"),
        exact_round(safe_div(F.sum("minutes"), F.sum("timed"))).alias("avg_delivery_mins"),
        exact_round(safe_div(F.sum("met") * 100, F.sum("rows"))).alias("sla_pct"))


def hourly_peak_bands(T: dict[str, DataFrame]) -> DataFrame:
    """Hours at or above the 90th (peak) / 75th (busy) percentile of hourly volume."""
    h = _hourly(T)
    q = h.agg(F.percentile(F.col("total_orders").cast("double"), [0.75, 0.9]).alias("_q"))  # 24 rows in
    n = F.col("total_orders")
    return (h.crossJoin(F.broadcast(q))
            # interpolated quantiles compared at 6 decimals (last-bit noise differs between engines)
            .withColumn("demand_band", F.when(n >= exact_round(F.col("_q")[1], 6), "peak")
                        .when(n >= exact_round(F.col("_q")[0], 6), "busy")
                        .otherwise("normal"))
            .withColumn("p75_orders", exact_round(F.col("_q")[0], 2))
            .withColumn("p90_orders", exact_round(F.col("_q")[1], 2)).drop("_q"))


def key_findings(T: dict[str, DataFrame]) -> DataFrame:
    """One row of report findings.  Ties: smaller id / name first."""
    sla = _sla_slim(T).agg(
        F.min_by("store_name", F.struct(-F.col("sla_pct"), F.col("store_id"))).alias("best_sla_store"),
        F.max("sla_pct").alias("best_sla_pct"),
        F.min_by("store_name", F.struct(F.col("sla_pct"), F.col("store_id"))).alias("worst_sla_store"),
        F.min("sla_pct").alias("worst_sla_pct"),
        exact_round(F.avg("sla_pct"), 2).alias("avg_sla_pct"))
    sla = sla.withColumn("sla_gap_to_target", exact_round(SLA_TARGET - F.col("avg_sla_pct"), 2))
    st = F.col("store_status")
    pnl = store_pnl_summary(T).agg(
        F.sum(F.when(st == "PROFITABLE", 1).otherwise(0)).cast("bigint").alias("profitable_stores"),
        F.sum(F.when(st == "MARGINAL", 1).otherwise(0)).cast("bigint").alias("marginal_stores"),
        F.sum(F.when(st == "LOSS MAKING", 1).otherwise(0)).cast("bigint").alias("loss_making_stores"))
    cat = category_performance(T).agg(
        F.min_by(F.struct("category", "total_revenue", "avg_margin_pct"),
                 F.struct(-F.col("total_revenue"), F.col("category"))).alias("_c"))
    cat = cat.select(F.col("_c.category").alias("top_category"),
                     F.col("_c.total_revenue").alias("top_category_revenue"),
                     F.col("_c.avg_margin_pct").alias("top_category_margin_pct"))
    pk = picker_productivity(T, with_rank=False).agg(
        F.min_by(F.struct("picker_name", "avg_pick_rate"), F.struct(-F.col("avg_pick_rate"), F.col("picker_id")))
        .alias("_p"), F.avg("avg_pick_rate").alias("_avg"))
    pk = pk.select(F.col("_p.picker_name").alias("top_picker"), F.col("_p.avg_pick_rate").alias("top_pick_rate"),
                   exact_round("_avg", 3).alias("avg_pick_rate"),
                   exact_round((F.col("_p.avg_pick_rate") / F.col("_avg") - 1) * 100, 1).alias("top_picker_uplift_pct"))
    sb = substitution_bands(T)
    key = [F.col("original_category"), F.col("same_category"), F.col("reason_for_sub")]
    sub = sb.agg(
        F.min_by(F.struct("original_category", "acceptance_rate_pct"),
                 F.struct(-F.col("acceptance_rate_pct"), *key)).alias("_b"),
        F.min_by(F.struct("original_category", "acceptance_rate_pct"),
                 F.struct(F.col("acceptance_rate_pct"), *key)).alias("_w"))
    sub = sub.select(F.col("_b.original_category").alias("best_sub_category"),
                     F.col("_b.acceptance_rate_pct").alias("best_sub_pct"),
                     F.col("_w.original_category").alias("worst_sub_category"),
                     F.col("_w.acceptance_rate_pct").alias("worst_sub_pct"))
    hr = _hourly(T).agg(
        F.min_by("order_hour", F.struct(-F.col("total_orders"), F.col("order_hour"))).alias("peak_hour"),
        F.max("total_orders").alias("peak_orders"))
    return sla.crossJoin(pnl).crossJoin(cat).crossJoin(pk).crossJoin(sub).crossJoin(hr)


def orders_by_city(T: dict[str, DataFrame]) -> DataFrame:
    per = T["fact_orders"].groupBy("store_id").agg(F.count(F.lit(1)).alias("_n"))
    return (per.join(store_dim(T, "city"), "store_id").groupBy("city")
            .agg(F.sum("_n").cast("bigint").alias("total_orders")))


def order_status_share(T: dict[str, DataFrame]) -> DataFrame:
    c = T["fact_orders"].groupBy("order_status").agg(F.count(F.lit(1)).alias("row_count"))
    tot = c.agg(F.sum("row_count").alias("_t"))
    return c.crossJoin(F.broadcast(tot)).select(
        "order_status", "row_count", exact_round(safe_div(F.col("row_count") * 100, "_t"), 1).alias("pct"))


def revenue_vs_delivery_cost(T: dict[str, DataFrame]) -> DataFrame:
    per = delivered(T["fact_orders"]).groupBy("store_id").agg(
        exact_round(F.sum("net_order_value_inr"), 0).alias("revenue"),
        exact_round(F.sum("delivery_cost_inr"), 0).alias("delivery_cost"))
    return per.join(store_dim(T, "store_name"), "store_id")


def apply_slicers(T: dict[str, DataFrame], city: str | None = None, store: str | None = None,
                  date_from: str | None = None, date_to: str | None = None,
                  skill: str | None = None, shift: str | None = None) -> dict[str, DataFrame]:
    """Dashboard slicers as optional filters on the table set.

    City/store/date restrict the store-keyed facts (a semi join against the
    sliced, nation-bounded store list plus date predicates that reach the
    scan); skill/shift restrict pickers and their activity.
    """
    out = dict(T)
    stores = T["dim_stores"]
    some_stores = city is not None or store is not None
    if city is not None:
        stores = stores.filter(F.col("city") == city)
    if store is not None:
        stores = stores.filter((F.col("store_id") == store) | (F.col("store_name") == store))
    out["dim_stores"] = stores
    keep = F.broadcast(stores.select("store_id"))
    for t in ("fact_orders", "fact_order_items", "fact_picker_activity", "fact_substitutions"):
        df = T[t]
        if some_stores:
            df = df.join(keep, "store_id", "left_semi")
        for limit, beyond in ((date_from, "__ge__"), (date_to, "__le__")):
            if limit is not None:
                df = df.filter(getattr(F.col("order_date"), beyond)(F.lit(limit).cast("date")))
                if "order_month" in df.columns:      # the stored facts' partition column: other months are not opened
                    df = df.filter(getattr(F.col("order_month"), beyond)(F.lit(limit[:7])))
        out[t] = df
    pickers = T["dim_pickers"]
    if skill is not None:
        pickers = pickers.filter(F.col("skill_level") == skill)
    if shift is not None:
        pickers = pickers.filter(F.col("shift") == shift)
    if skill is not None or shift is not None:
        out["dim_pickers"] = pickers
        out["fact_picker_activity"] = out["fact_picker_activity"].join(pickers.select("picker_id"), "picker_id",
                                                                       "left_semi")
    return sliced(T, out, keep if some_stores else None, date_from, date_to)
