"""Explicit schemas of the eight star-schema tables (raw form).

Readers never infer types: CSV and Parquet are read with these StructTypes.
Columns added by cleaning are listed in ``CLEAN_EXTRA``.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, TS = T.StringType(), T.DateType(), T.TimestampNTZType()
I, L, DB, B = T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
MONEY, MINS = T.DecimalType(18, 2), T.DecimalType(9, 2)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STORES = _schema(
    ("store_id", S), ("store_name", S), ("city", S), ("zone", S), ("latitude", DB),
    ("longitude", DB), ("store_area_sqft", I), ("max_picker_capacity", I), ("launch_date", D),
    ("monthly_fixed_cost_inr", L), ("catchment_radius_km", DB), ("is_active", B))

SKUS = _schema(
    ("sku_id", S), ("sku_name", S), ("category", S), ("subcategory", S), ("brand", S),
    ("unit_price_inr", MONEY), ("mrp_inr", MONEY), ("cost_price_inr", MONEY),
    ("gross_margin_pct", DB), ("weight_kg", DB), ("shelf_life_days", I),
    ("requires_refrigeration", B), ("velocity_class", S), ("is_active", B))

CUSTOMERS = _schema(
    ("customer_id", S), ("customer_name", S), ("phone", S), ("email", S), ("city", S),
    ("pin_code", S), ("signup_date", D), ("customer_segment", S), ("preferred_payment", S),
    ("avg_basket_size_inr", MONEY), ("lifetime_orders", I), ("is_active", B))

PICKERS = _schema(
    ("picker_id", S), ("picker_name", S), ("store_id", S), ("shift", S), ("join_date", D),
    ("experience_months", I), ("skill_level", S), ("monthly_salary_inr", L), ("is_active", B))

ORDERS = _schema(
    ("order_id", S), ("store_id", S), ("customer_id", S), ("order_timestamp", TS),
    ("order_date", D), ("order_hour", I), ("day_of_week", S), ("month", I), ("quarter", I),
    ("is_weekend", B), ("payment_method", S), ("order_value_inr", MONEY),
    ("discount_amount_inr", MONEY), ("delivery_charge_inr", MONEY), ("platform_fee_inr", MONEY),
    ("net_order_value_inr", MONEY), ("pick_time_mins", MINS), ("pack_time_mins", MINS),
    ("dispatch_time_mins", MINS), ("travel_time_mins", MINS), ("total_delivery_mins", MINS),
    ("sla_met", B), ("distance_km", MINS), ("delivery_cost_inr", MONEY), ("order_status", S),
    ("num_items", I), ("had_substitution", B), ("customer_rating", I))

ORDER_ITEMS = _schema(
    ("item_id", S), ("order_id", S), ("store_id", S), ("sku_id", S), ("category", S),
    ("quantity", I), ("unit_price_inr", MONEY), ("unit_cost_inr", MONEY),
    ("item_total_inr", MONEY), ("item_margin_inr", MONEY), ("is_substituted", B),
    ("order_date", D))

PICKER_ACTIVITY = _schema(
    ("activity_id", S), ("order_id", S), ("picker_id", S), ("store_id", S),
    ("pick_start_time", TS), ("pick_end_time", TS), ("pick_duration_mins", MINS),
    ("items_picked", I), ("pick_rate_per_min", DB), ("errors_made", I), ("order_date", D),
    ("shift", S))

SUBSTITUTIONS = _schema(
    ("substitution_id", S), ("order_id", S), ("store_id", S), ("original_sku_id", S),
    ("substitute_sku_id", S), ("original_category", S), ("substitute_category", S),
    ("same_category", B), ("price_difference_inr", MONEY), ("customer_accepted", B),
    ("reason_for_sub", S), ("order_date", D))

AUDIT = _schema(("table", S), ("issue_found", S), ("action_taken", S), ("rows_affected", L))

RAW_SCHEMAS = {
    "dim_stores": STORES, "dim_skus": SKUS, "dim_customers": CUSTOMERS,
    "dim_pickers": PICKERS, "fact_orders": ORDERS, "fact_order_items": ORDER_ITEMS,
    "fact_picker_activity": PICKER_ACTIVITY, "fact_substitutions": SUBSTITUTIONS,
}

CLEAN_EXTRA = {
    "dim_stores": [("store_age_days", I), ("cost_per_sqft", DB)],
    "dim_skus": [("gross_margin_pct_actual", DB), ("is_high_margin", B)],
    "dim_customers": [("tenure_days", I)],
    "dim_pickers": [("annual_cost_inr", L)],
    "fact_orders": [("gross_profit_inr", MONEY), ("is_profitable", B),
                    ("order_hour_band", S), ("delivery_speed_band", S)],
    "fact_order_items": [("item_margin_pct", DB)],
    "fact_picker_activity": [("productivity_band", S)],
    "fact_substitutions": [("acceptance_label", S)],
}

TABLE_NAMES = list(RAW_SCHEMAS)
FACT_TABLES = [t for t in TABLE_NAMES if t.startswith("fact_")]


def clean_schema(table: str) -> T.StructType:
    s = T.StructType(list(RAW_SCHEMAS[table].fields))
    for n, t in CLEAN_EXTRA[table]:
        s = s.add(n, t, True)
    return s
