"""Picker productivity.

Activity rows are aggregated to (picker, store[, shift]) first; the picker
dimension (which grows with ``supplier``) is joined after that, and left to
the planner/AQE to broadcast only when its runtime size is small.  Rankings
over pickers use ``exact_rank`` (no single-partition window).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.functions.exprs import exact_mean, exact_round, safe_div
from storepulse.operators.ranking import exact_rank
from storepulse.plans.common import store_dim
from storepulse.sources.tables import staged

# fixed values: performance thresholds relative to the store / network mean
HIGH_FACTOR, LOW_FACTOR = 1.1, 0.9
ERROR_FLAG_PCT = 10.0


def _per_picker(T: dict[str, DataFrame]) -> DataFrame:
    return T["fact_picker_activity"].groupBy("picker_id", "store_id").agg(
        F.count("activity_id").alias("total_picks"),
        exact_mean("pick_rate_per_min", 4).alias("_rate"),
        exact_mean("pick_duration_mins").alias("_dur"),
        exact_mean("items_picked", 0).alias("_items"),
        F.sum("errors_made").cast("bigint").alias("total_errors"))


def picker_productivity(T: dict[str, DataFrame], with_rank: bool = True) -> DataFrame:
    """Per picker and store; with ``with_rank`` ranked by mean rate, best first."""
    per = _per_picker(T)
    if with_rank:
        # ranked on identifiers and rates alone, among the rows that the joins below keep
        per = (per.join(T["dim_pickers"].select("picker_id"), "picker_id", "left_semi")
               .join(store_dim(T), "store_id", "left_semi"))
        per = exact_rank(staged(per, "picker_rates"), "_rate", "productivity_rank")
    p = (per
         .join(T["dim_pickers"].select("picker_id", "picker_name", "skill_level", "shift"), "picker_id")
         .join(store_dim(T, "store_name"), "store_id"))
    out = p.select(
        "picker_id", "picker_name", "skill_level", "shift", "store_name", "total_picks",
        exact_round("_rate", 3).alias("avg_pick_rate"),
        exact_round("_dur", 2).alias("avg_pick_duration"),
        exact_round("_items", 1).alias("avg_items_per_order"),
        "total_errors",
        exact_round(safe_div(F.col("total_errors") * 100, "total_picks"), 2).alias("error_rate_pct"),
        *(["productivity_rank"] if with_rank else []))
    return out.orderBy("productivity_rank", "picker_id") if with_rank else out


def picker_vs_store_avg(T: dict[str, DataFrame]) -> DataFrame:
    """Picker mean rate vs the unweighted mean of picker means in the store."""
    p = (_per_picker(T).select("picker_id", "store_id", F.col("_rate").alias("picker_avg"))
         .join(T["dim_pickers"].select("picker_id", "picker_name", "skill_level"), "picker_id"))
    store_avg = p.groupBy("store_id").agg(F.avg("picker_avg").alias("store_avg"))   # ≤ one row per store
    j = p.join(F.broadcast(store_avg), "store_id").join(store_dim(T, "store_name"), "store_id")
    pa, sa = F.col("picker_avg"), F.col("store_avg")
    return j.select(
        "picker_id", "picker_name", "store_name", "skill_level",
        exact_round(pa, 3).alias("picker_avg_rate"),
        exact_round(sa, 3).alias("store_avg_rate"),
        exact_round(pa - sa, 3).alias("variance_from_store_avg"),
        F.when(pa > sa * HIGH_FACTOR, "HIGH PERFORMER").when(pa < sa * LOW_FACTOR, "NEEDS COACHING")
        .otherwise("ON TRACK").alias("performance_flag"),
    ).orderBy("store_name", F.col("picker_avg_rate").desc(), "picker_id")


def skill_productivity(T: dict[str, DataFrame]) -> DataFrame:
    """Per skill level (roster attribute joined to every activity, left join)."""
    per = T["fact_picker_activity"].groupBy("picker_id").agg(
        F.sum(F.col("pick_rate_per_min").cast("decimal(18,4)")).alias("_r"),
        F.sum("pick_duration_mins").alias("_d"),
        F.sum("items_picked").alias("_i"),
        F.count(F.lit(1)).alias("_n"))
    j = per.join(T["dim_pickers"].select("picker_id", "skill_level"), "picker_id", "left")
    g = j.groupBy("skill_level").agg(F.sum("_r").alias("_r"), F.sum("_d").alias("_d"),
                                     F.sum("_i").alias("_i"), F.sum("_n").alias("total_activities"))
    return g.select(
        "skill_level",
        exact_round(safe_div("_r", "total_activities"), 4).alias("avg_pick_rate"),
        exact_round(safe_div("_d", "total_activities"), 2).alias("avg_pick_duration"),
        exact_round(safe_div("_i", "total_activities"), 2).alias("avg_items_picked"),
        F.col("total_activities").cast("bigint").alias("total_activities"))


def shift_productivity(T: dict[str, DataFrame]) -> DataFrame:
    """Per activity shift (derived from the order hour, not the roster shift)."""
    return T["fact_picker_activity"].groupBy("shift").agg(
        exact_round(exact_mean("pick_rate_per_min", 4), 4).alias("avg_pick_rate"),
        exact_round(exact_mean("errors_made", 0), 4).alias("error_rate"),
        F.count(F.lit(1)).alias("total_activities"))


def store_pick_rate(T: dict[str, DataFrame]) -> DataFrame:
    s = T["fact_picker_activity"].groupBy("store_id").agg(exact_mean("pick_rate_per_min", 4).alias("_r"))
    net = s.agg(F.avg("_r").alias("_net"))                # one row (store-sized input)
    return (s.crossJoin(F.broadcast(net)).join(store_dim(T, "store_name"), "store_id")
            .select("store_id", "store_name", exact_round("_r", 4).alias("avg_pick_rate"),
                    exact_round("_net", 4).alias("network_avg_pick_rate"))
            .orderBy("avg_pick_rate", "store_id"))


def picker_bands(T: dict[str, DataFrame]) -> DataFrame:
    """Picker report colouring: rate vs the network mean of (rounded) picker
    rates, and an error-rate flag."""
    p = picker_productivity(T, with_rank=False).select("picker_id", "picker_name", "skill_level", "shift", "store_name",
                                      "total_picks", "avg_pick_rate", "total_errors", "error_rate_pct")
    net = p.agg(F.avg("avg_pick_rate").alias("network_avg_rate"))   # one row
    r = F.col("avg_pick_rate")
    n = F.col("network_avg_rate")
    return (p.crossJoin(F.broadcast(net))
            .withColumn("rate_band", F.when(r >= n * HIGH_FACTOR, "green").when(r < n * LOW_FACTOR, "red")
                        .otherwise("none"))
            .withColumn("high_error_flag", F.col("error_rate_pct") > ERROR_FLAG_PCT)
            .withColumn("network_avg_rate", exact_round("network_avg_rate", 4)))


def pick_rate_by_store_skill_shift(T: dict[str, DataFrame]) -> DataFrame:
    """Mean pick rate along store, skill and (activity) shift in one pass.

    Activity rows are first reduced to (picker, store, shift) partial sums;
    the three axes are then GROUPING SETS over that small aggregate.
    """
    per = T["fact_picker_activity"].groupBy("picker_id", "store_id", "shift").agg(
        F.sum(F.col("pick_rate_per_min").cast("decimal(18,4)")).alias("_r"),
        F.count(F.lit(1)).alias("_n"))
    j = (per.join(T["dim_pickers"].select("picker_id", "skill_level"), "picker_id")
         .join(store_dim(T, "store_name"), "store_id"))
    g = j.groupingSets([["store_name"], ["skill_level"], ["shift"]], "store_name", "skill_level", "shift") \
        .agg(F.sum("_r").alias("_r"), F.sum("_n").alias("activities"))
    axis = (F.when(F.col("store_name").isNotNull(), "store")
            .when(F.col("skill_level").isNotNull(), "skill_level").otherwise("shift"))
    return g.select(axis.alias("axis"), F.coalesce("store_name", "skill_level", "shift").alias("axis_value"),
                    exact_round(safe_div("_r", "activities"), 4).alias("avg_pick_rate"),
                    F.col("activities").cast("bigint").alias("activities"))


def picker_concentration(T: dict[str, DataFrame], top_fraction: float = 0.10) -> DataFrame:
    """Share of all picks made by the top ``top_fraction`` of pickers (by picks).

    A picker is "top" when RANK() by picks (descending) ≤ ceil(fraction × pickers).
    """
    picks = T["fact_picker_activity"].groupBy("picker_id").agg(F.count(F.lit(1)).alias("picks"))
    picks = staged(picks, "picks")
    ranked = exact_rank(picks, "picks", "_rk")
    n = picks.agg(F.count(F.lit(1)).alias("n_pickers"), F.sum("picks").alias("total_picks"))
    j = ranked.crossJoin(F.broadcast(n))
    # exact decimal product: a double 30 * 0.1 would ceil to 4
    top = F.col("_rk") <= F.ceil(F.col("n_pickers") * F.lit(Decimal(str(top_fraction))))
    return j.groupBy("n_pickers", "total_picks").agg(
        F.sum(F.when(top, 1).otherwise(0)).cast("bigint").alias("top_pickers"),
        F.sum(F.when(top, F.col("picks")).otherwise(0)).cast("bigint").alias("top_picks")) \
        .select("n_pickers", "top_pickers", "top_picks", F.col("total_picks").cast("bigint").alias("total_picks"),
                exact_round(safe_div(F.col("top_picks") * 100, "total_picks"), 2).alias("top_share_pct"))


def error_vs_experience(T: dict[str, DataFrame]) -> DataFrame:
    """Correlation of picker error rate with experience months (rounded to 6)."""
    per = T["fact_picker_activity"].groupBy("picker_id").agg(
        safe_div(F.sum("errors_made") * 100, F.count(F.lit(1))).alias("_err"))
    j = per.join(T["dim_pickers"].select("picker_id", "experience_months"), "picker_id")
    return j.agg(F.count(F.lit(1)).alias("n_pickers"),
                 exact_round(F.corr("_err", F.col("experience_months").cast("double")), 6)
                 .alias("corr_error_experience"))
