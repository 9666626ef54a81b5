"""Business rules of the data generator, re-aimed as Spark column derivations."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.functions.exprs import round_dec, weekday_name, is_weekend
from storepulse.sources.fixtures import SKILL_EFFICIENCY, shift_from_hour

# fixed values: free-delivery threshold, delivery fee, platform fee rate
FREE_DELIVERY_MIN = 149
DELIVERY_FEE = 25
PLATFORM_FEE_RATE = "0.03"


def order_calendar_features(orders: DataFrame) -> DataFrame:
    """X1: date, hour, weekday name, month, quarter, weekend flag from the timestamp."""
    ts = F.col("order_timestamp")
    d = F.to_date(ts)
    return orders.select(
        "order_id", "order_timestamp", d.alias("order_date"), F.hour(ts).alias("order_hour"),
        weekday_name(d).alias("day_of_week"), F.month(d).alias("month"), F.quarter(d).alias("quarter"),
        is_weekend(d).alias("is_weekend"))


def order_value_build(orders: DataFrame, free_min=FREE_DELIVERY_MIN, fee=DELIVERY_FEE,
                      fee_rate: str = PLATFORM_FEE_RATE) -> DataFrame:
    """X2: delivery charge, platform fee and net value from value and discount."""
    v = F.col("order_value_inr")
    charge = F.when(v >= free_min, F.lit(0)).otherwise(F.lit(fee)).cast("decimal(18,2)")
    platform = round_dec(v * F.lit(Decimal(fee_rate)))
    net = round_dec(v - F.col("discount_amount_inr") + charge + platform)
    return orders.select("order_id", "order_value_inr", "discount_amount_inr",
                         charge.alias("delivery_charge_inr"), platform.alias("platform_fee_inr"),
                         net.alias("net_order_value_inr"))


def rate_3dp(items, minutes, eff):
    """round(items / minutes × eff, 3) half-up, in integer arithmetic; null when minutes is 0."""
    n = items.cast("bigint") * 100 * (eff * 1000).cast("bigint")
    d = F.nullif((minutes * 100).cast("bigint"), F.lit(0).cast("bigint"))
    return F.floor((n * 2 + d) / (d * 2)).cast("double") / 1000.0


def pick_activity_build(activity: DataFrame, pickers: DataFrame) -> DataFrame:
    """X3: end time, pick rate and shift of each recorded pick activity, from its start,
    duration and items and the picker's skill."""
    skills = pickers.select("picker_id", "skill_level")
    eff = F.lit(None).cast("double")
    for skill, factor in SKILL_EFFICIENCY.items():
        eff = F.when(F.col("skill_level") == skill, F.lit(factor)).otherwise(eff)
    mins, start = F.col("pick_duration_mins"), F.col("pick_start_time")
    return activity.join(skills, "picker_id").select(
        "activity_id", "order_id", "picker_id", "store_id", "pick_start_time",
        F.timestamp_add("SECOND", (mins * 60).cast("int"), start).alias("pick_end_time"),
        "pick_duration_mins", "items_picked", rate_3dp(F.col("items_picked"), mins, eff).alias("pick_rate_per_min"),
        shift_from_hour(F.hour(start)).alias("shift"))


def substitution_pairs(subs: DataFrame, skus: DataFrame) -> DataFrame:
    """X4: same-category flag and price difference from two SKU lookups."""
    o = skus.select(F.col("sku_id").alias("original_sku_id"), F.col("category").alias("_oc"),
                    F.col("unit_price_inr").alias("_op"))
    s = skus.select(F.col("sku_id").alias("substitute_sku_id"), F.col("category").alias("_sc"),
                    F.col("unit_price_inr").alias("_sp"))
    j = subs.select("substitution_id", "original_sku_id", "substitute_sku_id") \
        .join(o, "original_sku_id").join(s, "substitute_sku_id")
    return j.select("substitution_id", "original_sku_id", "substitute_sku_id",
                    F.col("_oc").alias("original_category"), F.col("_sc").alias("substitute_category"),
                    (F.col("_oc") == F.col("_sc")).alias("same_category"),
                    (F.col("_sp") - F.col("_op")).cast("decimal(18,2)").alias("price_difference_inr"))


def item_economics(items: DataFrame, skus: DataFrame) -> DataFrame:
    """X5: item total and margin from the SKU's price and cost."""
    k = skus.select("sku_id", "unit_price_inr", "cost_price_inr")
    j = items.select("item_id", "order_id", "sku_id", "quantity").join(k, "sku_id")
    q = F.col("quantity")
    return j.select("item_id", "order_id", "sku_id", "quantity",
                    round_dec(F.col("unit_price_inr") * q).alias("item_total_inr"),
                    round_dec((F.col("unit_price_inr") - F.col("cost_price_inr")) * q).alias("item_margin_inr"))
