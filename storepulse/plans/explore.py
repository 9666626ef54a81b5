"""Exploratory suite: all orders (any status) unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.exprs import exact_mean, exact_round, rate_pct, month_start, safe_div, weekday_name
from storepulse.plans.summaries import mean_of, month_date, summary
from storepulse.plans.common import delivered, store_dim
from storepulse.plans.sla import day_number

# fixed values: store SLA colour cut-offs, variable-cost share of revenue
SLA_RED, SLA_AMBER = 80.0, 88.0
VARIABLE_COST_SHARE = 0.38


def business_kpis(T: dict[str, DataFrame]) -> DataFrame:
    o = T["fact_orders"]
    st = F.col("order_status")
    return o.agg(
        F.count(F.lit(1)).alias("total_orders"),
        exact_round(F.sum("net_order_value_inr"), 2).alias("total_revenue"),
        exact_round(F.sum("gross_profit_inr"), 2).alias("total_profit"),
        exact_round(exact_mean("net_order_value_inr"), 2).alias("avg_order_value"),
        exact_round(exact_mean("total_delivery_mins"), 2).alias("avg_delivery_mins"),
        exact_round(rate_pct(F.col("sla_met")), 2).alias("sla_pct"),
        exact_round(rate_pct(F.col("is_profitable")), 2).alias("profitable_pct"),
        F.countDistinct("customer_id").alias("unique_customers"),
        exact_round(rate_pct(st == "Cancelled"), 2).alias("cancellation_rate"),
        exact_round(rate_pct(st == "RTO"), 2).alias("rto_rate"))


def monthly_trend(T: dict[str, DataFrame]) -> DataFrame:
    """Per month: volume, revenue, minutes, SLA %; flags the first peak month.

    The month aggregate is bounded by the calendar, so the window that finds
    the peak runs over a few dozen rows.
    """
    m = T["fact_orders"].groupBy(month_start("order_date").alias("month")).agg(
        F.count("order_id").alias("total_orders"),
        F.sum("net_order_value_inr").alias("_rev"),
        exact_round(exact_mean("total_delivery_mins"), 2).alias("avg_delivery"),
        exact_round(rate_pct(F.col("sla_met")), 2).alias("sla_pct"))
    w = Window.orderBy(F.col("total_orders").desc(), "month")
    return m.select(
        "month", "total_orders", exact_round("_rev", 2).alias("total_revenue"), "avg_delivery", "sla_pct",
        exact_round(F.col("_rev").cast("double") / 100000.0, 2).alias("revenue_lac"),
        (F.row_number().over(w) == 1).alias("is_peak_month"))


def _store_sla(T: dict[str, DataFrame]) -> DataFrame:
    """All orders by store, from the stored sums."""
    return summary(T, "store_months").groupBy("store_id").agg(
        F.sum("orders").cast("bigint").alias("total_orders"),
        safe_div(F.sum("met") * 100, F.sum("rows")).alias("_met"),
        mean_of("minutes").alias("_d"), mean_of("pick").alias("_p"), mean_of("travel").alias("_t"))


def store_sla_bands(T: dict[str, DataFrame]) -> DataFrame:
    s = _store_sla(T).join(store_dim(T, "store_name", "city"), "store_id")
    met = F.col("_met")
    return s.select(
        "store_id", "store_name", "city", "total_orders",
        exact_round(met, 2).alias("sla_met_pct"), exact_round(100.0 - met, 2).alias("sla_fail_pct"),
        exact_round("_d", 2).alias("avg_delivery"), exact_round("_p", 2).alias("avg_pick_time"),
        exact_round("_t", 2).alias("avg_travel_time"),
        F.when(met < SLA_RED, "red").when(met < SLA_AMBER, "amber").otherwise("green").alias("sla_band"),
    ).orderBy("sla_met_pct", "store_id")


HOURS = list(range(24))


def demand_heatmap(T: dict[str, DataFrame]) -> DataFrame:
    """Weekday × hour order counts as a pivot (Mon..Sun rows, h00..h23 columns).

    Explicit pivot values avoid the extra distinct-values job; missing
    cells stay null.
    """
    o = T["fact_orders"].withColumn("day_name", weekday_name("order_date"))
    p = o.groupBy("day_name").pivot("order_hour", HOURS).agg(F.sum(F.lit(1)).cast("bigint"))
    p = p.select("day_name", *[F.col(str(h)).alias(f"h{h:02d}") for h in HOURS])
    return p.withColumn("day_number", day_number("day_name")).orderBy("day_number")


def _store_month_revenue(T: dict[str, DataFrame]) -> DataFrame:
    return delivered(summary(T, "store_months")).select("store_id", month_date().alias("month"), F.col("revenue").alias("_mrev"))


def _pnl_estimate(T: dict[str, DataFrame]) -> DataFrame:
    s = _store_month_revenue(T).groupBy("store_id").agg(
        exact_mean("_mrev").alias("_avg"), F.sum("_mrev").alias("_tot"),
        F.countDistinct("month").alias("months_active"))
    s = s.join(store_dim(T, "store_name", "city", "monthly_fixed_cost_inr"), "store_id")
    var = F.col("_avg") * VARIABLE_COST_SHARE
    profit = F.col("_avg") - var - F.col("monthly_fixed_cost_inr").cast("double")
    return s.withColumn("_var", var).withColumn("_profit", profit)


def store_pnl_estimate(T: dict[str, DataFrame]) -> DataFrame:
    """Delivered revenue per store-month; variable cost a fixed share of revenue."""
    s = _pnl_estimate(T)
    return s.select(
        "store_id", "store_name", "city", "monthly_fixed_cost_inr", "months_active",
        exact_round("_avg", 2).alias("avg_monthly_revenue"), exact_round("_tot", 2).alias("total_revenue"),
        exact_round("_var", 2).alias("avg_variable_cost"), exact_round("_profit", 2).alias("avg_monthly_profit"),
        exact_round(safe_div("_profit", "_avg") * 100, 2).alias("profit_margin_pct"),
        (F.col("_profit") > 0).alias("is_profitable"),
        exact_round(F.col("monthly_fixed_cost_inr").cast("double") / (1 - VARIABLE_COST_SHARE), 0)
        .alias("breakeven_monthly_revenue"),
    ).orderBy("avg_monthly_profit", "store_id")


def eda_findings(T: dict[str, DataFrame]) -> DataFrame:
    """One row of headline findings (SLA, P&L, substitutions).  Ties for
    best/worst are broken by the smaller store id."""
    sla = _store_sla(T).join(store_dim(T, "store_name"), "store_id")
    f1 = sla.agg(
        F.sum(F.when(F.col("_met") < SLA_RED, 1).otherwise(0)).cast("bigint").alias("stores_below_80_sla"),
        F.min_by("store_name", F.struct(-F.col("_met"), F.col("store_id"))).alias("best_sla_store"),
        F.min_by("store_name", F.struct(F.col("_met"), F.col("store_id"))).alias("worst_sla_store"))
    pnl = _pnl_estimate(T)
    f2 = pnl.agg(
        F.sum(F.when(F.col("_profit") > 0, 1).otherwise(0)).cast("bigint").alias("profitable_stores"),
        F.count(F.lit(1)).alias("stores_with_revenue"),
        F.min_by("store_name", F.struct(-F.col("_profit"), F.col("store_id"))).alias("best_profit_store"),
        F.min_by("store_name", F.struct(F.col("_profit"), F.col("store_id"))).alias("worst_profit_store"))
    s = T["fact_substitutions"]
    acc, same = F.col("customer_accepted"), F.col("same_category")
    f3 = s.agg(
        exact_round(rate_pct(acc), 1).alias("overall_acceptance_pct"),
        exact_round(rate_pct(acc & same, F.sum(F.when(same, 1).otherwise(0))), 1).alias("same_category_acceptance_pct"),
        exact_round(rate_pct(acc & ~same, F.sum(F.when(~same, 1).otherwise(0))), 1).alias("diff_category_acceptance_pct"))
    return f1.crossJoin(f2).crossJoin(f3)
