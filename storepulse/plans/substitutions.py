"""Substitution acceptance and stock-out signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.functions.exprs import exact_mean, exact_round, rate_pct, safe_div, count_true
from storepulse.plans.common import delivered

# fixed values: acceptance colour thresholds (percent)
ACCEPT_GREEN, ACCEPT_RED = 70.0, 50.0


def _acc(k: int = 2):
    return exact_round(rate_pct(F.col("customer_accepted")), k)


def substitution_acceptance(T: dict[str, DataFrame]) -> DataFrame:
    return T["fact_substitutions"].groupBy("original_category", "same_category", "reason_for_sub").agg(
        F.count("substitution_id").alias("total_substitutions"),
        count_true(F.col("customer_accepted")).alias("accepted_count"),
        _acc().alias("acceptance_rate_pct"),
        exact_round(exact_mean("price_difference_inr")).alias("avg_price_diff"),
    ).orderBy(F.col("acceptance_rate_pct").desc(), "original_category", "same_category", "reason_for_sub")


def sku_stockout(T: dict[str, DataFrame], k: int = 20) -> DataFrame:
    """Most-substituted SKUs: rejection % and substitutions per 100 Delivered orders."""
    n_del = delivered(T["fact_orders"]).agg(F.count(F.lit(1)).alias("_n_del"))    # one row
    per = T["fact_substitutions"].groupBy("original_sku_id").agg(
        F.count("substitution_id").alias("times_substituted"),
        count_true(~F.col("customer_accepted")).alias("_rej"))
    # ids that share a name, category and class are one group, as in the reference
    j = (per.join(T["dim_skus"].select(F.col("sku_id").alias("original_sku_id"), "sku_name", "category",
                                       "velocity_class"), "original_sku_id")
         .groupBy("sku_name", "category", "velocity_class")
         .agg(F.sum("times_substituted").alias("times_substituted"), F.sum("_rej").alias("_rej"))
         .crossJoin(F.broadcast(n_del)))
    out = j.select(
        "sku_name", "category", "velocity_class", "times_substituted",
        exact_round(safe_div(F.col("_rej") * 100, "times_substituted"), 2).alias("rejection_rate_pct"),
        exact_round(safe_div(F.col("times_substituted") * 100, "_n_del"), 4).alias("sub_rate_per_order_pct"))
    return out.orderBy(F.col("times_substituted").desc(), "sku_name", "category", "velocity_class").limit(k)


def acceptance_by_match(T: dict[str, DataFrame]) -> DataFrame:
    s = T["fact_substitutions"].groupBy("same_category").agg(
        _acc().alias("acceptance_rate"), F.count("substitution_id").alias("total_subs"))
    return s.withColumn("match_type", F.when(F.col("same_category"), "Same Category")
                        .when(~F.col("same_category"), "Different Category"))


def acceptance_by_reason(T: dict[str, DataFrame]) -> DataFrame:
    return T["fact_substitutions"].groupBy("reason_for_sub").agg(
        _acc().alias("acceptance_rate"), F.count("substitution_id").alias("total_subs"))


def acceptance_by_category(T: dict[str, DataFrame]) -> DataFrame:
    s = T["fact_substitutions"]
    overall = s.agg(_acc().alias("overall_acceptance_rate"))     # one row
    return (s.groupBy("original_category").agg(_acc().alias("acceptance_rate"),
                                               F.count("substitution_id").alias("total_subs"))
            .crossJoin(F.broadcast(overall)).orderBy("acceptance_rate", "original_category"))


def substitution_bands(T: dict[str, DataFrame]) -> DataFrame:
    a = T["fact_substitutions"].groupBy("original_category", "same_category", "reason_for_sub").agg(
        F.count("substitution_id").alias("total_subs"), _acc().alias("acceptance_rate_pct"))
    r = F.col("acceptance_rate_pct")
    return a.withColumn("acceptance_band", F.when(r >= ACCEPT_GREEN, "green").when(r < ACCEPT_RED, "red")
                        .otherwise("amber"))


def substitution_share(T: dict[str, DataFrame]) -> DataFrame:
    c = T["fact_substitutions"].groupBy("acceptance_label").agg(F.count(F.lit(1)).alias("row_count"))
    tot = c.agg(F.sum("row_count").alias("_t"))
    return c.crossJoin(F.broadcast(tot)).select(
        "acceptance_label", "row_count", exact_round(safe_div(F.col("row_count") * 100, "_t"), 1).alias("pct"))
