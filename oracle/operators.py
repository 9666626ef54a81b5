"""Oracle SQL for the operator-level keys (DuckDB, over fx_* / cl_* CTEs)."""

from __future__ import annotations

from oracle import analytics
from oracle.analytics import DLV, MONTH, TIME_BAND, _div
from oracle.base import MEAN, PCT, R2, RD

SQL: dict[str, str] = {}

SQL["filter_delivered"] = f"""
SELECT order_id, store_id, order_date, net_order_value_inr, total_delivery_mins FROM {DLV}"""

SQL["filter_comparison"] = """
SELECT order_id, total_delivery_mins, net_order_value_inr, order_hour, payment_method, num_items FROM cl_orders
WHERE total_delivery_mins > 10 AND net_order_value_inr >= 100000 AND order_hour < 12 AND payment_method <> 'COD'
  AND num_items <= 6"""

SQL["filter_between"] = """
SELECT order_id, customer_rating, total_delivery_mins, customer_rating BETWEEN 2 AND 4 AS rating_2_to_4,
       NOT coalesce(customer_rating BETWEEN 2 AND 4, FALSE) AS rating_outside_2_to_4,
       total_delivery_mins BETWEEN 8 AND 10 AS minutes_8_to_10
FROM cl_orders"""

SQL["filter_isin"] = """
SELECT order_id, payment_method, order_status FROM cl_orders
WHERE payment_method IN ('UPI', 'Card') AND order_status NOT IN ('RTO')"""

SQL["case_when_flags"] = f"""
SELECT order_id, CASE WHEN sla_met THEN 'SLA Met' ELSE 'SLA Breached' END AS sla_status, {TIME_BAND} AS time_band,
       CASE WHEN net_order_value_inr >= 300000 THEN 'high' WHEN net_order_value_inr >= 100000 THEN 'mid' ELSE 'low' END AS value_tier
FROM cl_orders"""

SQL["join_inner_store"] = """
SELECT o.order_id, o.store_id, o.net_order_value_inr, s.store_name, s.city
FROM cl_orders o JOIN cl_stores s ON o.store_id = s.store_id"""

SQL["join_inner_multi"] = """
SELECT a.activity_id, p.picker_name, p.skill_level, s.store_name, a.pick_rate_per_min
FROM cl_picker_activity a JOIN cl_pickers p ON a.picker_id = p.picker_id JOIN cl_stores s ON a.store_id = s.store_id"""

SQL["join_left_enrich"] = """
SELECT a.activity_id, a.picker_id, a.store_id, a.shift, p.store_id AS store_id_picker, p.shift AS shift_picker,
       p.skill_level, s.store_name, s.city
FROM cl_picker_activity a LEFT JOIN cl_pickers p ON a.picker_id = p.picker_id
LEFT JOIN cl_stores s ON a.store_id = s.store_id"""

SQL["semi_join_fk"] = """
SELECT item_id, order_id FROM fx_order_items WHERE order_id IN (SELECT order_id FROM cl_orders)"""

SQL["anti_join_orphans"] = """
SELECT item_id, order_id FROM fx_order_items i
WHERE NOT EXISTS (SELECT 1 FROM cl_orders o WHERE o.order_id = i.order_id)"""

SQL["cross_join_scalar"] = f"""
SELECT store_id, orders, network_orders, {RD(_div('orders * 100', 'network_orders'), 2)} AS share_pct
FROM (SELECT store_id, COUNT(*) AS orders FROM {DLV} GROUP BY store_id)
CROSS JOIN (SELECT COUNT(*) AS network_orders FROM {DLV})"""

SQL["semi_join_subquery"] = f"""
SELECT order_id, customer_id, order_status FROM cl_orders
WHERE customer_id IN (SELECT customer_id FROM {DLV} GROUP BY customer_id HAVING COUNT(*) >= 20)"""

SQL["agg_basic"] = f"""
SELECT store_id, order_status, COUNT(order_id) AS orders, {RD('SUM(net_order_value_inr)', 2)} AS revenue,
       {RD(MEAN('total_delivery_mins'), 2)} AS avg_minutes, CAST(MIN(total_delivery_mins) AS DOUBLE) AS min_minutes,
       CAST(MAX(total_delivery_mins) AS DOUBLE) AS max_minutes
FROM cl_orders GROUP BY store_id, order_status"""

SQL["agg_conditional_rate"] = f"""
SELECT store_id, {RD(PCT('sla_met'), 2)} AS sla_pct, {RD(PCT('is_profitable'), 2)} AS profitable_pct,
       {RD(PCT('is_weekend'), 2)} AS weekend_pct, {RD(PCT("order_status = 'Cancelled'"), 2)} AS cancelled_pct
FROM cl_orders GROUP BY store_id"""

SQL["agg_count_distinct"] = """
SELECT store_id, COUNT(DISTINCT customer_id) AS distinct_customers, COUNT(DISTINCT order_date) AS distinct_days,
       COUNT(DISTINCT payment_method) AS distinct_payment_methods
FROM cl_orders GROUP BY store_id"""

SQL["agg_two_level"] = f"""
SELECT store_id, COUNT(*) AS months, {RD(MEAN('_n', 0), 1)} AS avg_monthly_orders, MAX(_n) AS max_monthly_orders
FROM (SELECT store_id, {MONTH} AS month, COUNT(*) AS _n FROM cl_orders GROUP BY 1, 2) GROUP BY store_id"""

SQL["status_counts"] = "SELECT order_status, COUNT(*) AS row_count FROM cl_orders GROUP BY order_status"

# numeric columns of cleaned orders with their decimal scale (0 = integer)
def _describe(table: str, source: str, c: str, dtype: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    scale = int(dtype.split(",")[1].rstrip(")")) if dtype.startswith("decimal") else 0
    mean = f"AVG({c})" if dtype == "double" else MEAN(c, scale)
    return (f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT({c}) AS count, "
            f"{RD(mean, 2)} AS mean, {RD(f'stddev_samp({x})', 2)} AS std, {RD(f'MIN({x})', 2)} AS min, "
            f"{RD(f'quantile_cont({x}, 0.25)', 2)} AS p25, {RD(f'quantile_cont({x}, 0.5)', 2)} AS p50, "
            f"{RD(f'quantile_cont({x}, 0.75)', 2)} AS p75, {RD(f'MAX({x})', 2)} AS max FROM {source}")


SQL["window_rank"] = f"""
SELECT store_id, {RD('rev', 0)} AS total_revenue, CAST(RANK() OVER (ORDER BY rev DESC NULLS LAST) AS BIGINT) AS revenue_rank
FROM (SELECT store_id, SUM(net_order_value_inr) AS rev FROM {DLV} GROUP BY store_id)"""

SQL["dedup_keep_first"] = "SELECT * FROM od1"

CLEAN_TABLES = {
    "dim_stores": "cl_stores", "dim_skus": "cl_skus", "dim_customers": "cl_customers", "dim_pickers": "cl_pickers",
    "fact_orders": "cl_orders", "fact_order_items": "cl_order_items",
    "fact_picker_activity": "cl_picker_activity", "fact_substitutions": "cl_substitutions",
}
RAW_TABLES = {t: c.replace("cl_", "fx_") for t, c in CLEAN_TABLES.items()}

SQL["table_row_counts"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS rows FROM {c}" for t, c in CLEAN_TABLES.items())


def _columns(clean: bool = False):
    from storepulse.sources.schemas import RAW_SCHEMAS, clean_schema
    return {t: [(f.name, f.dataType.simpleString()) for f in (clean_schema(t) if clean else RAW_SCHEMAS[t]).fields]
            for t in RAW_TABLES}


def _raw_columns():
    return {t: [c for c, _ in cols] for t, cols in _columns().items()}


SQL["describe_numeric"] = "\nUNION ALL\n".join(
    _describe(t, RAW_TABLES[t], c, dt) for t, cols in _columns().items() for c, dt in cols
    if dt in ("int", "bigint", "double") or dt.startswith("decimal"))


def _profile_nulls() -> str:
    parts = []
    for t, cols in _columns().items():
        for c, dt in cols:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, "
                         f"COUNT(*) AS n, '{dt}' AS dtype FROM {RAW_TABLES[t]}")
    u = "\nUNION ALL\n".join(parts)
    return (f"SELECT table_name, column_name, null_count, "
            f"{RD('CAST(null_count AS DOUBLE) / CAST(n AS DOUBLE) * 100', 2)} AS null_pct, dtype "
            f"FROM ({u}) WHERE null_count > 0")


SQL["profile_nulls"] = _profile_nulls()

SQL["profile_duplicates"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM {r}) AS rows, "
    f"(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {r})) AS distinct_rows, "
    f"(SELECT COUNT(*) FROM {r}) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {r})) AS duplicate_rows"
    for t, r in RAW_TABLES.items())

SQL["table_shape"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS rows, {len(cols)} AS columns FROM {RAW_TABLES[t]}"
    for t, cols in _raw_columns().items())

_DUP_KEYS = {
    "dim_stores": "store_id", "dim_skus": "sku_id", "dim_customers": "email", "dim_pickers": "picker_id",
    "fact_orders": "order_id", "fact_order_items": "item_id", "fact_picker_activity": "activity_id",
    "fact_substitutions": "substitution_id",
}
SQL["duplicate_key_count"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{k}' AS key_columns, COUNT(*) AS rows, "
    f"(SELECT COUNT(*) FROM (SELECT DISTINCT {k} FROM {RAW_TABLES[t]})) AS distinct_keys, "
    f"COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {k} FROM {RAW_TABLES[t]})) AS duplicate_keys "
    f"FROM {RAW_TABLES[t]}" for t, k in _DUP_KEYS.items())

# ---------------------------------------------------------------- features

SQL["order_calendar_features"] = """
SELECT order_id, order_timestamp, CAST(order_timestamp AS DATE) AS order_date,
       CAST(hour(order_timestamp) AS INTEGER) AS order_hour, dayname(order_timestamp) AS day_of_week,
       CAST(month(order_timestamp) AS INTEGER) AS month, CAST(quarter(order_timestamp) AS INTEGER) AS quarter,
       isodow(order_timestamp) >= 6 AS is_weekend
FROM cl_orders"""

_CHARGE = "CAST(CASE WHEN order_value_inr >= 149 THEN 0 ELSE 25 END AS DECIMAL(18,2))"
_FEE = R2("order_value_inr * 0.03")
SQL["order_value_build"] = f"""
SELECT order_id, order_value_inr, discount_amount_inr, {_CHARGE} AS delivery_charge_inr, {_FEE} AS platform_fee_inr,
       {R2(f'order_value_inr - discount_amount_inr + {_CHARGE} + {_FEE}')} AS net_order_value_inr
FROM cl_orders"""

_EFF = ("CASE skill_level WHEN 'Expert' THEN CAST(1.25 AS DOUBLE) WHEN 'Intermediate' THEN CAST(1.0 AS DOUBLE) "
        "WHEN 'Beginner' THEN CAST(0.78 AS DOUBLE) END")
_RATE_N, _RATE_D = f"(CAST(a.items_picked AS BIGINT) * 100 * CAST({_EFF} * 1000 AS BIGINT))", "NULLIF(CAST(a.pick_duration_mins * 100 AS BIGINT), 0)"
SQL["pick_activity_build"] = f"""
SELECT a.activity_id, a.order_id, a.picker_id, a.store_id, a.pick_start_time,
       a.pick_start_time + INTERVAL 1 SECOND * CAST(a.pick_duration_mins * 60 AS INTEGER) AS pick_end_time,
       a.pick_duration_mins, a.items_picked,
       CAST(floor(({_RATE_N} * 2 + {_RATE_D}) / ({_RATE_D} * 2)) AS DOUBLE) / 1000.0 AS pick_rate_per_min,
       CASE WHEN hour(a.pick_start_time) < 12 THEN 'Morning' WHEN hour(a.pick_start_time) < 18 THEN 'Afternoon' ELSE 'Night' END AS shift
FROM cl_picker_activity a JOIN cl_pickers p ON a.picker_id = p.picker_id"""

SQL["substitution_pairs"] = """
SELECT x.substitution_id, x.original_sku_id, x.substitute_sku_id, o.category AS original_category,
       s.category AS substitute_category, o.category = s.category AS same_category,
       CAST(s.unit_price_inr - o.unit_price_inr AS DECIMAL(18,2)) AS price_difference_inr
FROM cl_substitutions x JOIN cl_skus o ON x.original_sku_id = o.sku_id JOIN cl_skus s ON x.substitute_sku_id = s.sku_id"""

SQL["item_economics"] = f"""
SELECT i.item_id, i.order_id, i.sku_id, i.quantity, {R2('k.unit_price_inr * i.quantity')} AS item_total_inr,
       {R2('(k.unit_price_inr - k.cost_price_inr) * i.quantity')} AS item_margin_inr
FROM cl_order_items i JOIN cl_skus k ON i.sku_id = k.sku_id"""

# ---------------------------------------------------------------- UPDATE script


def _u(tag: str) -> str:
    return (f"(CAST(('0x' || substr(md5(concat_ws('|', '42', '{tag}', order_id)), 1, 8))::BIGINT AS DOUBLE) "
            f"/ CAST(4294967296.0 AS DOUBLE))")


_M2 = "CAST(pick_time_mins + pack_time_mins + dispatch_time_mins + travel_time_mins AS DECIMAL(9,2))"

SQL["recompute_total"] = f"""
SELECT order_id, pick_time_mins, pack_time_mins, dispatch_time_mins, travel_time_mins, {_M2} AS total_delivery_mins FROM cl_orders"""
SQL["recompute_sla"] = f"""
SELECT order_id, total_delivery_mins, total_delivery_mins <= 10 AS sla_met
FROM (SELECT order_id, {_M2} AS total_delivery_mins FROM cl_orders)"""
SQL["recompute_profit"] = f"""
SELECT order_id, net_order_value_inr, delivery_cost_inr, {R2('net_order_value_inr - delivery_cost_inr')} AS gross_profit_inr
FROM cl_orders"""
SQL["recompute_profitable"] = f"""
SELECT order_id, gross_profit_inr, gross_profit_inr > 0 AS is_profitable
FROM (SELECT order_id, {R2('net_order_value_inr - delivery_cost_inr')} AS gross_profit_inr FROM cl_orders)"""

_COST = R2(f"CAST(net_order_value_inr AS DOUBLE) * ({_u('delivery_cost')} * CAST(0.3 AS DOUBLE) + CAST(0.85 AS DOUBLE))")
SQL["sample_exact_fraction"] = f"""
SELECT order_id,
       CASE WHEN repriced THEN {_COST} ELSE delivery_cost_inr END AS delivery_cost_inr,
       CASE WHEN repriced THEN {R2(f'net_order_value_inr - {_COST}')} ELSE gp END AS gross_profit_inr,
       CASE WHEN repriced THEN {R2(f'net_order_value_inr - {_COST}')} > 0 ELSE gp > 0 END AS is_profitable,
       repriced
FROM (SELECT order_id, net_order_value_inr, delivery_cost_inr,
             {R2('net_order_value_inr - delivery_cost_inr')} AS gp,
             ROW_NUMBER() OVER (ORDER BY md5(concat_ws('|', '42', 'reprice', order_id)), order_id)
               <= ROUND(COUNT(*) OVER () * 0.12) AS repriced
      FROM cl_orders)"""

_RATES = ("CASE store_id WHEN 'STR_001' THEN 0.78 WHEN 'STR_002' THEN 0.82 WHEN 'STR_003' THEN 0.65 "
          "WHEN 'STR_004' THEN 0.85 WHEN 'STR_005' THEN 0.72 WHEN 'STR_006' THEN 0.91 WHEN 'STR_007' THEN 0.61 "
          "WHEN 'STR_008' THEN 0.76 WHEN 'STR_009' THEN 0.69 WHEN 'STR_010' THEN 0.88 ELSE 0 END")
SQL["stratified_flag"] = f"""
SELECT order_id, store_id, order_status,
       CASE WHEN order_status = 'Delivered' THEN rn <= floor(total * {_RATES}) ELSE FALSE END AS sla_met
FROM (SELECT order_id, store_id, order_status,
             ROW_NUMBER() OVER (PARTITION BY store_id, order_status = 'Delivered'
                                ORDER BY md5(concat_ws('|', '42', 'sla', order_id)), order_id) AS rn,
             COUNT(*) OVER (PARTITION BY store_id, order_status = 'Delivered') AS total
      FROM cl_orders)"""

_GP = R2("net_order_value_inr - delivery_cost_inr")
UPDATED = f"""q_u1 AS (
  SELECT * REPLACE ({_M2} AS total_delivery_mins, {_M2} <= 10 AS sla_met, {_GP} AS gross_profit_inr, {_GP} > 0 AS is_profitable)
  FROM cl_orders),
q_u2 AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY md5(concat_ws('|', '42', 'reprice', order_id)), order_id)
              <= ROUND(COUNT(*) OVER () * 0.12) AS repriced FROM q_u1),
q_u3 AS (
  SELECT * EXCLUDE (repriced) REPLACE (
    CASE WHEN repriced THEN {_COST} ELSE delivery_cost_inr END AS delivery_cost_inr,
    CASE WHEN repriced THEN {R2(f'net_order_value_inr - {_COST}')} ELSE gross_profit_inr END AS gross_profit_inr,
    CASE WHEN repriced THEN {R2(f'net_order_value_inr - {_COST}')} > 0 ELSE is_profitable END AS is_profitable)
  FROM q_u2),
up_orders AS (
  SELECT * EXCLUDE (rn, total) REPLACE (
    CASE WHEN order_status = 'Delivered' THEN rn <= floor(total * {_RATES}) ELSE FALSE END AS sla_met)
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id, order_status = 'Delivered'
                                     ORDER BY md5(concat_ws('|', '42', 'sla', order_id)), order_id) AS rn,
               COUNT(*) OVER (PARTITION BY store_id, order_status = 'Delivered') AS total
        FROM q_u3))"""


def _on_updated(body: str) -> str:
    return f"WITH {UPDATED}\n" + body.replace("cl_orders", "up_orders")


for _k in ("sla_share", "profitable_share", "delivery_summary", "sla_pct_by_store"):
    SQL[f"{_k}_updated"] = _on_updated(analytics.SQL[_k])

# ---------------------------------------------------------------- cleaning

for _k, _t in {"clean_stores": "dim_stores", "clean_skus": "dim_skus", "clean_customers": "dim_customers",
               "clean_pickers": "dim_pickers", "clean_orders": "fact_orders",
               "clean_order_items": "fact_order_items", "clean_picker_activity": "fact_picker_activity",
               "clean_substitutions": "fact_substitutions"}.items():
    SQL[_k] = f"SELECT * FROM {CLEAN_TABLES[_t]}"


def _a(table: str, issue: str, action: str, count_sql: str, always: bool = False) -> str:
    return (f"SELECT '{table}' AS \"table\", '{issue}' AS issue_found, '{action}' AS action_taken, "
            f"CAST(({count_sql}) AS BIGINT) AS rows_affected, {str(always).upper()} AS _always")


def _n(t: str, where: str = "TRUE") -> str:
    return f"SELECT COUNT(*) FROM {t} WHERE {where}"


_AUDIT = [
    _a("dim_stores", "Coordinates outside the service area", "Flagged for review",
       _n("fx_stores", "NOT coalesce(latitude BETWEEN 8.0 AND 37.0, FALSE) OR NOT coalesce(longitude BETWEEN 68.0 AND 97.0, FALSE)")),
    _a("dim_stores", "Fixed cost not positive", "Rows removed",
       _n("fx_stores", "NOT coalesce(monthly_fixed_cost_inr > 0, FALSE)")),
    _a("dim_stores", "Derived columns", "store_age_days, cost_per_sqft added; city title-cased", _n("cl_stores"), True),
    _a("dim_skus", "Unit price not positive", "Rows removed", f"({_n('fx_skus')}) - ({_n('sk1')})"),
    _a("dim_skus", "Cost at or above selling price", "Cost set to 80% of selling price",
       _n("sk1", "cost_price_inr >= unit_price_inr")),
    _a("dim_skus", "MRP below selling price", "MRP set to 110% of selling price", _n("sk1", "mrp_inr < unit_price_inr")),
    _a("dim_skus", "Shelf life not positive", "Rows removed", f"({_n('sk3')}) - ({_n('cl_skus')})"),
    _a("dim_skus", "Derived columns", "gross_margin_pct_actual, is_high_margin added", _n("cl_skus"), True),
    _a("dim_customers", "Signup date in the future", "Rows removed",
       _n("fx_customers", "NOT coalesce(signup_date <= DATE '1999-12-31', FALSE)")),
    _a("dim_customers", "Basket size not positive", "Rows removed",
       _n("fx_customers", "coalesce(signup_date <= DATE '1999-12-31', FALSE) AND NOT coalesce(avg_basket_size_inr > 0, FALSE)")),
    _a("dim_customers", "Basket size above the 99th percentile", "Capped at the 99th percentile",
       "SELECT COUNT(*) FROM cu1, cu_p99 WHERE avg_basket_size_inr > p99"),
    _a("dim_customers", "Negative lifetime orders", "Set to 0", _n("cu1", "lifetime_orders < 0")),
    _a("dim_customers", "Duplicate emails", "Kept first occurrence", f"({_n('cu2')}) - ({_n('cl_customers')})"),
    _a("dim_customers", "Derived columns", "tenure_days added", _n("cl_customers"), True),
    _a("dim_pickers", "Join date in the future", "Rows removed", f"({_n('fx_pickers')}) - ({_n('pk1')})"),
    _a("dim_pickers", "Salary out of range", "Replaced with median salary",
       _n("pk1", "NOT coalesce(monthly_salary_inr BETWEEN 10000 AND 35000, FALSE)")),
    _a("dim_pickers", "Store not found", "Rows removed", f"({_n('pk2')}) - ({_n('cl_pickers')})"),
    _a("dim_pickers", "Experience recalculated from join date", "experience_months, annual_cost_inr updated",
       _n("cl_pickers"), True),
    _a("fact_orders", "Duplicate order ids", "Kept first occurrence", f"({_n('fx_orders')}) - ({_n('od1')})"),
    _a("fact_orders", "Order value not positive", "Rows removed", f"({_n('od1')}) - ({_n('od2')})"),
    *[_a("fact_orders", f"Negative {c}", "Replaced with median", _n("od2", f"{c} < 0"))
      for c in ("pick_time_mins", "pack_time_mins", "dispatch_time_mins", "travel_time_mins")],
    _a("fact_orders", "Delivery time differs from its components", "Recalculated from components",
       _n("od3", "abs(total_delivery_mins - CAST(pick_time_mins + pack_time_mins + dispatch_time_mins + travel_time_mins AS DECIMAL(9,2))) > 0.5")),
    _a("fact_orders", "SLA flag recalculated", "sla_met = total_delivery_mins <= 10", _n("od4"), True),
    _a("fact_orders", "Delivery time above 120 minutes", "Rows removed", f"({_n('od4')}) - ({_n('od5')})"),
    _a("fact_orders", "Discount at or above order value", "Discount set to 0",
       _n("od5", "discount_amount_inr >= order_value_inr")),
    _a("fact_orders", "Store not found", "Rows removed", f"({_n('od5')}) - ({_n('cl_orders')})"),
    _a("fact_orders", "Derived columns", "gross_profit_inr, is_profitable, bands added", _n("cl_orders"), True),
    _a("fact_order_items", "Orphan items", "Rows removed",
       f"({_n('fx_order_items', 'quantity > 0 AND unit_price_inr > 0')}) - ({_n('cl_order_items')})"),
    _a("fact_picker_activity", "Pick rate above 20 items/min", "Capped at 20",
       _n("fx_picker_activity", "pick_duration_mins > 0 AND pick_rate_per_min > 20")),
    _a("fact_picker_activity", "Picker not found", "Rows removed",
       f"({_n('fx_picker_activity', 'pick_duration_mins > 0')}) - ({_n('cl_picker_activity')})"),
    _a("fact_substitutions", "Original equals substitute SKU", "Rows removed",
       _n("fx_substitutions", "NOT coalesce(original_sku_id <> substitute_sku_id, FALSE)")),
    _a("fact_substitutions", "Orphan substitutions", "Rows removed",
       f"({_n('fx_substitutions', 'original_sku_id <> substitute_sku_id')}) - ({_n('cl_substitutions')})"),
]
SQL["cleaning_audit"] = ("SELECT \"table\", issue_found, action_taken, rows_affected FROM (\n"
                         + "\nUNION ALL\n".join(_AUDIT) + "\n) WHERE rows_affected > 0 OR _always")

SQL["rows_before_after"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM {RAW_TABLES[t]}) AS rows_before, "
    f"(SELECT COUNT(*) FROM {c}) AS rows_after, "
    f"(SELECT COUNT(*) FROM {RAW_TABLES[t]}) - (SELECT COUNT(*) FROM {c}) AS rows_removed, "
    + (f"(SELECT {RD(PCT('sla_met'), 1)} FROM cl_orders) AS sla_met_pct, "
       f"(SELECT {RD(PCT('is_profitable'), 1)} FROM cl_orders) AS profitable_pct"
       if t == "fact_orders" else "CAST(NULL AS DOUBLE) AS sla_met_pct, CAST(NULL AS DOUBLE) AS profitable_pct")
    for t, c in CLEAN_TABLES.items())

# ---------------------------------------------------------------- sources and sinks (read back)


def _checksums(source: str, name: str, columns: list[tuple[str, str]], body: str) -> list[str]:
    parts = []
    for c, dtype in columns:
        text = f"CAST({c} AS VARCHAR)"
        if dtype == "double":
            text = f"CAST(CAST({c} AS DECIMAL(28,6)) AS VARCHAR)"
        elif dtype.startswith("timestamp"):
            text = f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
        parts.append(f"SELECT '{source}' AS source, '{name}' AS table_name, COUNT(*) AS rows, '{c}' AS column_name, "
                     f"COUNT({c}) AS non_null, CAST(COALESCE(SUM(('0x' || substr(md5({text}), 1, 8))::BIGINT), 0) AS BIGINT) AS checksum "
                     f"FROM {body}")
    return parts


_AUDIT_COLUMNS = [("\"table\"", "string"), ("issue_found", "string"), ("action_taken", "string"), ("rows_affected", "bigint")]


def _sinks() -> str:
    parts = []
    for fmt in ("parquet", "csv"):
        for t, cols in _columns(clean=True).items():
            parts += _checksums(fmt, t, cols, CLEAN_TABLES[t])
        audit = _checksums(fmt, "cleaning_audit", _AUDIT_COLUMNS, f"({SQL['cleaning_audit']})")
        parts += [p.replace("'\"table\"' AS column_name", "'table' AS column_name") for p in audit]
    return "\nUNION ALL\n".join(parts)


SQL["sink_roundtrip"] = _sinks()
SQL["csv_source"] = "\nUNION ALL\n".join(p for t, cols in _columns().items() for p in _checksums("csv", t, cols, RAW_TABLES[t]))


def _insights() -> str:
    A = analytics
    S, I, F = "string", "bigint", "double"
    tables = {
        "01_store_scorecard": (A.SQL["scorecard_export"].replace("network_sla_share_pct", "sla_pct"), [
            ("store_name", S), ("city", S), ("total_orders", I), ("revenue_lac", F), ("avg_delivery_mins", F), ("sla_pct", F),
            ("avg_profit_per_order", F)]),
        "02_sla_by_store": (A.SLA_SLIM, [
            ("store_name", S), ("city", S), ("total_orders", I), ("avg_delivery_mins", F), ("avg_pick_mins", F),
            ("avg_travel_mins", F), ("sla_pct", F)]),
        "03_store_pnl": (A.PNL_SUMMARY, [
            ("store_name", S), ("city", S), ("avg_monthly_revenue", F), ("avg_monthly_profit", F), ("fixed_cost", I), ("store_status", S)]),
        "04_category_performance": (A.CATEGORY_PERF, [
            ("category", S), ("total_qty", I), ("total_revenue", F), ("total_margin", F), ("avg_margin_pct", F)]),
        "05_picker_performance": (A.PICKER_PROD, [
            ("picker_name", S), ("skill_level", S), ("shift", S), ("store_name", S), ("total_picks", I), ("avg_pick_rate", F),
            ("total_errors", I), ("error_rate_pct", F)]),
        "06_substitution_analysis": (A.SUB_BANDS, [
            ("original_category", S), ("same_category", S), ("reason_for_sub", S), ("total_subs", I), ("acceptance_rate_pct", F)]),
        "07_hourly_demand": (A.HOURLY, [("order_hour", I), ("total_orders", I), ("avg_delivery_mins", F), ("sla_pct", F)]),
    }
    return "\nUNION ALL\n".join(p for name, (body, cols) in tables.items() for p in _checksums("csv", name, cols, f"({body})"))


SQL["insights_export"] = _insights()
