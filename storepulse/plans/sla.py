"""Delivery-time and SLA analytics over cleaned orders.

Every plan aggregates the fact table first (map-side partial aggregation on
a handful of keys) and only then joins the nation-bounded store dimension,
so the join touches at most one row per store (or store × bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.exprs import exact_mean, exact_round, rate_pct, safe_div
from storepulse.plans.common import delivered, store_dim
from storepulse.plans.summaries import summary

DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _sla(k: int = 2, sla_col: str = "sla_met"):
    return exact_round(rate_pct(F.col(sla_col)), k)


def sla_by_store(T: dict[str, DataFrame]) -> DataFrame:
    """Delivered orders per store: volume, mean minutes per stage, SLA %, distance."""
    agg = delivered(T["fact_orders"]).groupBy("store_id").agg(
        F.count("order_id").alias("total_orders"),
        exact_round(exact_mean("total_delivery_mins")).alias("avg_delivery_mins"),
        exact_round(exact_mean("pick_time_mins")).alias("avg_pick_mins"),
        exact_round(exact_mean("pack_time_mins")).alias("avg_pack_mins"),
        exact_round(exact_mean("dispatch_time_mins")).alias("avg_dispatch_mins"),
        exact_round(exact_mean("travel_time_mins")).alias("avg_travel_mins"),
        _sla().alias("sla_pct"),
        exact_round(exact_mean("distance_km")).alias("avg_distance_km"),
    )
    return agg.join(store_dim(T, "store_name", "city"), "store_id").orderBy("sla_pct", "store_id")


def sla_by_hour(T: dict[str, DataFrame]) -> DataFrame:
    return delivered(T["fact_orders"]).groupBy("order_hour").agg(
        F.count("order_id").alias("total_orders"),
        exact_round(exact_mean("total_delivery_mins")).alias("avg_delivery_mins"),
        _sla().alias("sla_pct"),
        exact_round(exact_mean("travel_time_mins")).alias("avg_travel_mins"),
        exact_round(exact_mean("pick_time_mins")).alias("avg_pick_mins"),
    ).orderBy("order_hour")


def delivery_percentiles(T: dict[str, DataFrame], accuracy: int | None = None) -> DataFrame:
    """p50/p75/p90/p95 of delivery minutes per store (linear interpolation).

    Exact percentiles come from the stored counts of minutes, which are bounded even for a store
    with a third of all orders.  ``accuracy`` switches to ``percentile_approx`` over the orders.
    """
    qs = [0.5, 0.75, 0.9, 0.95]
    x = F.col("total_delivery_mins").cast("double")
    if accuracy is None:
        agg = summary(T, "minute_counts").groupBy("store_id").agg(
            F.percentile(x, qs, F.col("rows")).alias("_p"), F.sum("orders").cast("bigint").alias("total_orders"))
    else:
        agg = delivered(T["fact_orders"]).groupBy("store_id").agg(
            F.percentile_approx(x, qs, accuracy).alias("_p"), F.count("order_id").alias("total_orders"))
    cols = [exact_round(F.col("_p")[i]).alias(n) for i, n in
            enumerate(["p50_delivery", "p75_delivery", "p90_delivery", "p95_delivery"])]
    return (agg.select("store_id", *cols, "total_orders")
            .join(store_dim(T, "store_name", "city"), "store_id")
            .orderBy(F.col("p90_delivery").desc(), "store_id"))


def weekend_sla(T: dict[str, DataFrame]) -> DataFrame:
    agg = delivered(T["fact_orders"]).groupBy("store_id", "is_weekend").agg(
        F.count("order_id").alias("total_orders"),
        exact_round(exact_mean("total_delivery_mins")).alias("avg_delivery_mins"),
        _sla().alias("sla_pct"),
    )
    return agg.join(store_dim(T, "store_name"), "store_id").orderBy("store_name", "is_weekend")


def rolling_7day_sla(T: dict[str, DataFrame], days: int = 7) -> DataFrame:
    """Daily SLA % per store and its trailing mean over the last ``days`` rows.

    The frame counts rows (days that have orders), not calendar days.  The
    window is partitioned by store over the *daily* aggregate, so each
    partition holds at most one row per calendar day.
    """
    daily = delivered(T["fact_orders"]).groupBy("store_id", "order_date").agg(
        F.count("order_id").alias("daily_orders"),
        _sla().alias("daily_sla_pct"),
    )
    w = Window.partitionBy("store_id").orderBy("order_date").rowsBetween(-(days - 1), 0)
    x = F.col("daily_sla_pct").cast("decimal(18,2)")
    roll = F.sum(x).over(w).cast("double") / F.count(x).over(w).cast("double")
    return daily.withColumn("rolling_7day_sla_pct", exact_round(roll)).orderBy("store_id", "order_date")


def sla_breach_contribution(T: dict[str, DataFrame]) -> DataFrame:
    status = F.when(F.col("sla_met"), "SLA Met").otherwise("SLA Breached")
    agg = delivered(T["fact_orders"]).groupBy("store_id", status.alias("sla_status")).agg(
        F.count("order_id").alias("order_count"),
        exact_round(exact_mean("pick_time_mins")).alias("avg_pick_time"),
        exact_round(exact_mean("pack_time_mins")).alias("avg_pack_time"),
        exact_round(exact_mean("travel_time_mins")).alias("avg_travel_time"),
        exact_round(exact_mean("total_delivery_mins")).alias("avg_total_delivery"),
    )
    return agg.join(store_dim(T, "store_name"), "store_id").orderBy("store_name", "sla_status")


def time_band(hour) -> F.Column:
    h = F.col(hour) if isinstance(hour, str) else hour
    return (F.when(h.between(7, 11), "Morning Peak").when(h.between(12, 17), "Afternoon")
            .when(h.between(18, 21), "Evening Peak").otherwise("Off Peak"))


def hourly_picker_workload(T: dict[str, DataFrame]) -> DataFrame:
    agg = delivered(T["fact_orders"]).groupBy("order_hour").agg(
        F.count("order_id").alias("total_orders"),
        exact_mean("pick_time_mins").alias("_avg_pick"),
    )
    return agg.select(
        "order_hour", "total_orders",
        exact_round("_avg_pick").alias("avg_pick_time"),
        exact_round(F.col("total_orders").cast("double") * F.col("_avg_pick") / 60.0, 1)
        .alias("picker_hours_needed"),
        time_band("order_hour").alias("time_band"),
    ).orderBy("order_hour")


def day_number(day_col: str = "day_of_week") -> F.Column:
    d = F.col(day_col)
    expr = None
    for i, name in enumerate(DAY_ORDER, start=1):
        expr = F.when(d == name, i) if expr is None else expr.when(d == name, i)
    return expr


def dow_demand(T: dict[str, DataFrame]) -> DataFrame:
    agg = delivered(T["fact_orders"]).groupBy("day_of_week").agg(
        F.count("order_id").alias("total_orders"),
        exact_round(exact_mean("net_order_value_inr")).alias("avg_order_value"),
        exact_round(exact_mean("total_delivery_mins")).alias("avg_delivery_mins"),
        _sla().alias("sla_pct"),
    )
    return agg.withColumn("day_number", day_number()).orderBy("day_number")


def sla_flag_counts(T: dict[str, DataFrame]) -> DataFrame:
    return T["fact_orders"].groupBy("sla_met").agg(F.count(F.lit(1)).alias("row_count"))


def delivery_summary(T: dict[str, DataFrame]) -> DataFrame:
    """Mean, extremes and median of the minutes of Delivered orders, from the stored counts of minutes."""
    t, n = F.col("total_delivery_mins"), F.col("rows")
    total = F.sum((t.cast("decimal(18,2)") * n).cast("decimal(28,2)"))
    return summary(T, "minute_counts").agg(
        exact_round(safe_div(total, F.sum(F.when(t.isNotNull(), n)))).alias("avg_delivery"),
        F.min(t).cast("double").alias("min_delivery"),
        F.max(t).cast("double").alias("max_delivery"),
        exact_round(F.percentile(t.cast("double"), 0.5, n), 4).alias("median_delivery"),
    )


def _share(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))
    # the grouped result has at most three rows (true/false/null): a global window is fine
    tot = F.sum("row_count").over(Window.partitionBy())
    return counts.withColumn("pct", exact_round(F.col("row_count").cast("double") * 100.0
                                                / tot.cast("double"), 1))


def sla_share(T: dict[str, DataFrame]) -> DataFrame:
    return _share(T["fact_orders"], "sla_met")


def profitable_share(T: dict[str, DataFrame]) -> DataFrame:
    return _share(T["fact_orders"], "is_profitable")


def sla_pct_by_store(T: dict[str, DataFrame]) -> DataFrame:
    agg = delivered(T["fact_orders"]).groupBy("store_id").agg(_sla(1).alias("sla_pct"))
    return agg.join(store_dim(T, "store_name"), "store_id").orderBy("sla_pct", "store_id")

