"""Store economics: monthly P&L, break-even, revenue density, growth,
customer frequency segments and the composite store scorecard.

Money sums are exact decimal sums; ratios are taken on their double value.
Two-level aggregates (store-month → store, customer → segment) are two
``groupBy``s; fact rows are never joined to another fact aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.exprs import exact_mean, exact_round, rate_pct, month_start, safe_div
from storepulse.plans.summaries import month_date, summary
from storepulse.plans.common import delivered, rank_desc, store_dim

# fixed values: P&L status thresholds, customer frequency cut-offs
MARGINAL_FLOOR = -50000
SEGMENTS = [(20, "Power User"), (10, "Regular"), (4, "Occasional")]
LAKH = 100000.0


def monthly_store_pnl(T: dict[str, DataFrame]) -> DataFrame:
    m = delivered(T["fact_orders"]).groupBy("store_id", month_start("order_date").alias("month")).agg(
        F.count("order_id").alias("total_orders"),
        F.sum("net_order_value_inr").alias("_rev"),
        F.sum("delivery_cost_inr").alias("_cost"),
        F.sum("discount_amount_inr").alias("_disc"),
        F.sum("gross_profit_inr").alias("_gp"),
    )
    j = m.join(store_dim(T, "store_name", "city", "monthly_fixed_cost_inr"), "store_id")
    net = F.col("_gp").cast("double") - F.col("monthly_fixed_cost_inr").cast("double")
    return j.select(
        "store_id", "store_name", "city", "month", "total_orders",
        exact_round("_rev", 0).alias("gross_revenue"),
        exact_round("_cost", 0).alias("total_delivery_cost"),
        exact_round("_disc", 0).alias("total_discounts"),
        "monthly_fixed_cost_inr",
        exact_round("_gp", 0).alias("gross_profit"),
        exact_round(net, 0).alias("net_profit"),
        exact_round(net / F.nullif(F.col("_rev").cast("double"), F.lit(0.0)) * 100, 2).alias("net_margin_pct"),
    ).orderBy("store_name", "month")


def _monthly(T: dict[str, DataFrame]) -> DataFrame:
    """Store-month revenue and profit (gross profit − fixed cost), from the stored sums."""
    m = delivered(summary(T, "store_months")).select("store_id", month_date().alias("month"), F.col("revenue").alias("monthly_revenue"),
                                                     F.col("profit").alias("_gp"))
    return (m.join(store_dim(T, "monthly_fixed_cost_inr"), "store_id")
            .withColumn("monthly_profit", (F.col("_gp") - F.col("monthly_fixed_cost_inr"))
                        .cast("decimal(20,2)")))


def pnl_status(avg_profit) -> F.Column:
    p = F.col(avg_profit) if isinstance(avg_profit, str) else avg_profit
    return (F.when(p > 0, "PROFITABLE").when(p > MARGINAL_FLOOR, "MARGINAL").otherwise("LOSS MAKING"))


def store_pnl_summary(T: dict[str, DataFrame]) -> DataFrame:
    s = _monthly(T).groupBy("store_id").agg(
        F.countDistinct("month").alias("months_active"),
        exact_mean("monthly_revenue").alias("_rev"),
        exact_mean("monthly_profit").alias("_profit"))
    return (s.join(store_dim(T, "store_name", "city", "monthly_fixed_cost_inr"), "store_id")
            .select("store_id", "store_name", "city", "months_active",
                    exact_round("_rev", 0).alias("avg_monthly_revenue"),
                    exact_round("_profit", 0).alias("avg_monthly_profit"),
                    F.col("monthly_fixed_cost_inr").alias("fixed_cost"),
                    pnl_status("_profit").alias("store_status"))
            .orderBy(F.col("avg_monthly_profit").desc(), "store_id"))


def break_even(T: dict[str, DataFrame], days_per_month: float = 30.0) -> DataFrame:
    """Orders needed to cover the fixed cost vs the actual daily volume.

    The naive form joins every order to every day of its store and averages;
    that fan-out is uniform per store, so both averages equal their plain
    per-store averages.  Each side is aggregated to store level and joined
    1:1 — no orders × days blow-up.  A negative average profit yields a
    negative break-even and is flagged ABOVE, exactly as the naive form.
    """
    d = delivered(T["fact_orders"])
    per_order = d.groupBy("store_id").agg(exact_mean("gross_profit_inr").alias("_avg_gp"))
    per_day = (d.groupBy("store_id", "order_date").agg(F.count("order_id").alias("_daily"))
               .groupBy("store_id").agg(exact_mean("_daily", 0).alias("_avg_daily")))
    j = (per_order.join(per_day, "store_id")
         .join(store_dim(T, "store_name", "city", "monthly_fixed_cost_inr"), "store_id"))
    fixed = F.col("monthly_fixed_cost_inr").cast("double")
    avg = F.nullif(F.col("_avg_gp"), F.lit(0.0))
    daily_be = F.ceil(fixed / avg / days_per_month).cast("bigint")
    actual = exact_round("_avg_daily", 0)
    return j.select(
        "store_id", "store_name", "city", "monthly_fixed_cost_inr",
        exact_round("_avg_gp").alias("avg_profit_per_order"),
        F.ceil(fixed / avg).cast("bigint").alias("orders_to_breakeven_monthly"),
        daily_be.alias("orders_to_breakeven_daily"),
        actual.alias("actual_avg_daily_orders"),
        F.when(actual >= daily_be, "ABOVE BREAKEVEN").otherwise("BELOW BREAKEVEN").alias("breakeven_status"),
    ).orderBy("orders_to_breakeven_daily", "store_id")


def revenue_per_sqft(T: dict[str, DataFrame]) -> DataFrame:
    r = delivered(T["fact_orders"]).groupBy("store_id").agg(F.sum("net_order_value_inr").alias("_rev"))
    j = r.join(store_dim(T, "store_name", "city", "store_area_sqft"), "store_id")
    return j.select(
        "store_id", "store_name", "city", "store_area_sqft",
        exact_round("_rev", 0).alias("total_revenue"),
        exact_round(F.col("_rev").cast("double") / F.col("store_area_sqft").cast("double"), 2)
        .alias("revenue_per_sqft"),
        rank_desc("_rev").alias("efficiency_rank"),
    ).orderBy(F.col("revenue_per_sqft").desc(), "store_id")


def monthly_growth(T: dict[str, DataFrame]) -> DataFrame:
    """Month-over-month revenue growth per store (previous month with data).

    LAG runs over the store-month aggregate partitioned by store: each
    partition holds one row per month.
    """
    m = delivered(T["fact_orders"]).groupBy("store_id", month_start("order_date").alias("month")).agg(
        exact_round(F.sum("net_order_value_inr"), 0).alias("monthly_revenue"))
    w = Window.partitionBy("store_id").orderBy("month")
    prev = F.lag("monthly_revenue").over(w)
    g = m.withColumn("prev_month_revenue", prev).withColumn(
        "mom_growth_pct",
        F.when(F.col("prev_month_revenue").isNull(), F.lit(None).cast("double")).otherwise(
            exact_round((F.col("monthly_revenue") - F.col("prev_month_revenue"))
                        / F.nullif(F.col("prev_month_revenue"), F.lit(0.0)) * 100, 2)))
    return g.join(store_dim(T, "store_name", "city"), "store_id").orderBy("store_name", "month")


def frequency_segment(n) -> F.Column:
    c = F.col(n) if isinstance(n, str) else n
    expr = None
    for cut, label in SEGMENTS:
        expr = F.when(c >= cut, label) if expr is None else expr.when(c >= cut, label)
    return expr.otherwise("One-Time")


def customer_segments(T: dict[str, DataFrame]) -> DataFrame:
    per_c = delivered(T["fact_orders"]).groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        exact_mean("net_order_value_inr").alias("avg_order_value"),
        F.sum("net_order_value_inr").alias("total_spend"))
    seg = per_c.withColumn("frequency_segment", frequency_segment("total_orders"))
    # mean of per-customer means: double inputs, rounded through decimal(28,10)
    return seg.groupBy("frequency_segment").agg(
        F.count("customer_id").alias("customer_count"),
        exact_round(exact_mean("total_orders", 0), 1).alias("avg_orders"),
        exact_round(F.avg("avg_order_value"), 2).alias("avg_order_value"),
        exact_round(exact_mean("total_spend"), 0).alias("avg_total_spend"),
    ).orderBy(F.col("avg_total_spend").desc())


def _store_metrics(T: dict[str, DataFrame]) -> DataFrame:
    return delivered(T["fact_orders"]).groupBy("store_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("net_order_value_inr").alias("_rev"),
        exact_mean("total_delivery_mins").alias("_mins"),
        rate_pct(F.col("sla_met")).alias("_sla"),
        exact_mean("net_order_value_inr").alias("_aov"),
        exact_mean("gross_profit_inr").alias("_gp"))


def store_scorecard(T: dict[str, DataFrame]) -> DataFrame:
    """Composite store ranking: mean of revenue, SLA and profit-per-order ranks."""
    m = _store_metrics(T).join(store_dim(T, "store_name", "city"), "store_id")
    ranked = (m.withColumn("revenue_rank", rank_desc("_rev"))
               .withColumn("sla_rank", rank_desc("_sla"))
               .withColumn("profit_rank", rank_desc("_gp")))
    return ranked.select(
        "store_id", "store_name", "city", "total_orders",
        exact_round(F.col("_rev").cast("double") / LAKH, 1).alias("revenue_lac"),
        exact_round("_mins", 2).alias("avg_delivery_mins"),
        exact_round("_sla", 1).alias("sla_pct"),
        exact_round("_aov", 0).alias("avg_order_value"),
        exact_round("_gp", 2).alias("avg_profit_per_order"),
        "revenue_rank", "sla_rank", "profit_rank",
        exact_round((F.col("revenue_rank") + F.col("sla_rank") + F.col("profit_rank")).cast("double") / 3.0, 1)
        .alias("composite_rank_score"),
    ).orderBy("composite_rank_score", "store_id")


def scorecard_export(T: dict[str, DataFrame]) -> DataFrame:
    """Scorecard variant whose SLA figure is the store's SLA-met Delivered orders as a
    share of all Delivered orders network-wide (``network_sla_share_pct``)."""
    d = delivered(T["fact_orders"])
    net = d.agg(F.count(F.lit(1)).alias("_net"))          # one row
    m = d.groupBy("store_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("net_order_value_inr").alias("_rev"),
        exact_mean("total_delivery_mins").alias("_mins"),
        F.sum(F.when(F.col("sla_met"), 1).otherwise(0)).alias("_met"),
        exact_mean("gross_profit_inr").alias("_gp"))
    j = m.crossJoin(F.broadcast(net)).join(store_dim(T, "store_name", "city"), "store_id")
    return j.select(
        "store_id", "store_name", "city", "total_orders",
        exact_round(F.col("_rev").cast("double") / LAKH, 1).alias("revenue_lac"),
        exact_round("_mins", 2).alias("avg_delivery_mins"),
        exact_round(safe_div(F.col("_met") * 100, "_net"), 1).alias("network_sla_share_pct"),
        exact_round("_gp", 2).alias("avg_profit_per_order"),
    ).orderBy(F.col("revenue_lac").desc(), "store_id")
