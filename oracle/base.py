"""DuckDB SQL for the fixture derivation and cleaning, as composable CTEs.

This is the independent oracle for the Spark plans: written directly as
SQL over the driver's views (region nation customer supplier part orders
lineitem), step by step (one CTE per rule), instead of the flag-column
runner the Spark side uses.  ``with_tables(body)`` prefixes a query body with
every CTE; DuckDB drops the unreferenced ones.

Raw tables are ``fx_*``; cleaned tables are ``cl_*``.
"""

from __future__ import annotations


def RD(x: str, k: int = 2) -> str:
    """Rounded double (decimal(28,10) first, like the Spark ``exact_round``)."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,10)), {k}) AS DOUBLE)"


def R2(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,10)), 2) AS DECIMAL(18,2))"


def RM(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,10)), 2) AS DECIMAL(9,2))"


def TITLE(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


def MEAN(x: str, scale: int = 2) -> str:
    """Exact-sum mean, same as ``exact_mean`` on the Spark side."""
    if scale == 0:
        return f"(CAST(SUM(CAST({x} AS BIGINT)) AS DOUBLE) / CAST(NULLIF(COUNT({x}), 0) AS DOUBLE))"
    return (f"(CAST(SUM(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE) "
            f"/ CAST(NULLIF(COUNT({x}), 0) AS DOUBLE))")


def PCT(pred: str, denom: str = "COUNT(*)") -> str:
    """100 * count(pred) / denom as double (unrounded)."""
    return (f"(CAST(SUM(CASE WHEN {pred} THEN 1 ELSE 0 END) AS DOUBLE) * 100.0 "
            f"/ CAST(NULLIF({denom}, 0) AS DOUBLE))")


def RATE4(items_x100: str, minutes_x100: str, eff: str) -> str:
    """round(items / minutes × eff, 4) half-up in integer arithmetic."""
    n = f"(({items_x100}) * CAST(({eff}) * 10000 AS BIGINT))"
    d = f"NULLIF({minutes_x100}, 0)"
    return f"(CAST(floor(({n} * 2 + {d}) / ({d} * 2)) AS DOUBLE) / 10000.0)"


def PAY(k: str) -> str:
    return f"CASE {k} % 4 WHEN 0 THEN 'UPI' WHEN 1 THEN 'Card' WHEN 2 THEN 'Wallet' ELSE 'COD' END"


def LINE_ID(prefix: str) -> str:
    return (f"concat_ws('_', '{prefix}', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
            f"CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))")


FIXTURE_CTES = f"""
fx_stores AS (
  SELECT printf('STR_%03d', n_nationkey + 1) AS store_id, n_name AS store_name,
         ' ' || lower(r_name) AS city, r_name AS zone,
         CAST(8 + (n_nationkey * 3) % 31 AS DOUBLE) AS latitude,
         CAST(70 + n_nationkey + CASE WHEN n_nationkey = 13 THEN 20 ELSE 0 END AS DOUBLE) AS longitude,
         CAST(2500 + n_nationkey * 40 AS INTEGER) AS store_area_sqft,
         CAST(8 + n_nationkey % 5 AS INTEGER) AS max_picker_capacity,
         DATE '1994-01-01' + CAST(n_nationkey * 30 AS INTEGER) AS launch_date,
         CAST(CASE WHEN n_nationkey = 24 THEN 0 WHEN n_nationkey % 8 = 7 THEN 9000000
                   ELSE 800000 + n_nationkey * 10000 END AS BIGINT) AS monthly_fixed_cost_inr,
         CAST(2.0 AS DOUBLE) + CAST(n_nationkey % 3 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS catchment_radius_km,
         TRUE AS is_active
  FROM nation JOIN region ON n_regionkey = r_regionkey),
sku_px0 AS (
  SELECT p_partkey, p_name, p_brand, p_type, p_size,
         CASE WHEN p_partkey % 83 = 5 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS price_d
  FROM part),
sku_px AS (
  SELECT *, {R2('price_d')} AS unit_price_inr,
         {R2('CASE WHEN p_partkey % 50 = 1 THEN price_d * 1.1 ELSE price_d * CAST(p_size % 20 + 68 AS DECIMAL(18,0)) * 0.01 END')} AS cost_price_inr,
         {R2('CASE WHEN p_partkey % 61 = 2 THEN price_d * 0.9 ELSE price_d * 1.15 END')} AS mrp_inr
  FROM sku_px0),
fx_skus AS (
  SELECT printf('SKU_%06d', p_partkey) AS sku_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS sku_name,
         ' ' || p_type AS category, p_brand AS subcategory, p_brand AS brand,
         unit_price_inr, mrp_inr, cost_price_inr,
         {RD('(CAST(unit_price_inr AS DOUBLE) - CAST(cost_price_inr AS DOUBLE)) / NULLIF(CAST(unit_price_inr AS DOUBLE), CAST(0.0 AS DOUBLE))', 4)} AS gross_margin_pct,
         CAST(p_size AS DOUBLE) / CAST(10.0 AS DOUBLE) AS weight_kg,
         CAST(p_size - 1 AS INTEGER) AS shelf_life_days,
         p_size % 7 = 0 AS requires_refrigeration,
         CASE p_partkey % 3 WHEN 0 THEN 'a ' WHEN 1 THEN 'b ' ELSE 'c ' END AS velocity_class,
         TRUE AS is_active
  FROM sku_px),
fx_customers AS (
  SELECT printf('CUST_%06d', c_custkey) AS customer_id, c_name AS customer_name,
         printf('9%09d', c_custkey) AS phone,
         upper(' user' || CAST(CASE WHEN c_custkey % 40 = 39 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR)
               || '@example.com ') AS email,
         g.r_name AS city, printf('%06d', c_nationkey + 110000) AS pin_code,
         DATE '1996-01-01' + CAST(c_custkey % 2500 AS INTEGER) AS signup_date,
         c_mktsegment AS customer_segment, {PAY('c_custkey')} AS preferred_payment,
         {R2('c_acctbal')} AS avg_basket_size_inr,
         CAST(c_custkey % 180 - 2 AS INTEGER) AS lifetime_orders, TRUE AS is_active
  FROM customer LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) g
       ON c_nationkey = g.n_nationkey),
fx_pickers AS (
  SELECT printf('PKR_%04d', s_suppkey) AS picker_id, s_name AS picker_name,
         printf('STR_%03d', s_nationkey + 1) AS store_id,
         CASE s_suppkey % 3 WHEN 0 THEN 'Morning' WHEN 1 THEN 'Afternoon' ELSE 'Night' END AS shift,
         DATE '1998-01-01' + CAST((s_suppkey * 37) % 1500 AS INTEGER) AS join_date,
         CAST(s_suppkey % 48 AS INTEGER) AS experience_months,
         CASE WHEN s_acctbal > 6500 THEN 'Expert' WHEN s_acctbal > 2500 THEN 'Intermediate' ELSE 'Beginner' END AS skill_level,
         CAST(CASE WHEN s_suppkey % 17 = 0 THEN 50000 ELSE 14000 + (s_suppkey * 100) % 10000 END AS BIGINT) AS monthly_salary_inr,
         TRUE AS is_active
  FROM supplier),
ord_k0 AS (
  SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS tp, o_custkey AS ck, o_orderdate, o_orderstatus,
         c_nationkey
  FROM orders JOIN customer ON o_custkey = c_custkey),
ord_k AS (
  SELECT k, tp, ck, o_orderdate, c_nationkey,
         CAST((k * 7) % 24 AS INTEGER) AS hr, CAST(o_orderdate AS DATE) AS od,
         tp * CAST(k % 5 AS DECIMAL(18,0)) * 0.05 AS disc_raw,
         {R2('CASE WHEN k % 401 = 3 THEN CAST(0 AS DECIMAL(18,2)) ELSE tp END')} AS val,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN 'Delivered' WHEN k % 9 < 7 THEN 'Cancelled' ELSE 'RTO' END AS st,
         {RM('CASE WHEN k % 97 = 0 THEN -1.0 ELSE CAST(k % 37 AS DECIMAL(18,0)) * 0.1 + 2 END')} AS pick,
         {RM('CAST(k % 11 AS DECIMAL(18,0)) * 0.1 + 1')} AS pack,
         {RM('CAST(k % 13 AS DECIMAL(18,0)) * 0.1 + 0.5')} AS disp,
         {RM('CASE WHEN k % 211 = 0 THEN 150.0 WHEN k % 307 = 0 THEN 30.0 WHEN k % 149 = 0 THEN 14.0 ELSE CAST(k % 41 AS DECIMAL(18,0)) * 0.1 + 1 END')} AS travel
  FROM ord_k0),
fx_orders_base AS (
  SELECT printf('ORD_%08d', k) AS order_id, printf('STR_%03d', c_nationkey + 1) AS store_id,
         printf('CUST_%06d', CASE WHEN ck % 40 < 4 THEN ck - ck % 40 ELSE ck END) AS customer_id,
         o_orderdate + INTERVAL 1 HOUR * hr AS order_timestamp, od AS order_date, hr AS order_hour,
         dayname(od) AS day_of_week, CAST(month(od) AS INTEGER) AS month, CAST(quarter(od) AS INTEGER) AS quarter,
         isodow(od) >= 6 AS is_weekend, {PAY('k')} AS payment_method,
         val AS order_value_inr,
         {R2('CASE WHEN k % 89 = 0 THEN tp ELSE disc_raw END')} AS discount_amount_inr,
         CAST(CASE WHEN val >= 149 THEN 0 ELSE 25 END AS DECIMAL(18,2)) AS delivery_charge_inr,
         {R2('tp * 0.03')} AS platform_fee_inr,
         {R2('tp * 1.03 - disc_raw')} AS net_order_value_inr,
         pick AS pick_time_mins, pack AS pack_time_mins, disp AS dispatch_time_mins, travel AS travel_time_mins,
         CAST(pick + pack + disp + travel + CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END AS DECIMAL(9,2)) AS total_delivery_mins,
         CAST(pick + pack + disp + travel + CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END AS DECIMAL(9,2)) <= 10 AS sla_met,
         {RM('CAST(k % 27 AS DECIMAL(18,0)) * 0.1 + 0.3')} AS distance_km,
         {R2('CASE WHEN k % 8 = 0 THEN tp * CAST(k % 31 + 85 AS DECIMAL(18,0)) * 0.01 ELSE CAST(k % 27 AS DECIMAL(18,0)) * 0.8 + 15 END')} AS delivery_cost_inr,
         st AS order_status, CAST(k % 11 + 1 AS INTEGER) AS num_items, k % 8 = 1 AS had_substitution,
         CAST(CASE WHEN st = 'Delivered' THEN k % 5 + 1 END AS INTEGER) AS customer_rating,
         k
  FROM ord_k),
fx_orders AS (
  SELECT * EXCLUDE (k) FROM fx_orders_base
  UNION ALL
  SELECT * EXCLUDE (k) FROM fx_orders_base WHERE k % 500 = 0),
fx_order_items AS (
  SELECT {LINE_ID('ITM')} AS item_id, printf('ORD_%08d', l_orderkey) AS order_id,
         printf('STR_%03d', c_nationkey + 1) AS store_id, printf('SKU_%06d', l_partkey) AS sku_id,
         p_type AS category,
         CAST(CASE WHEN l_orderkey % 173 = 0 THEN 0 ELSE l_quantity END AS INTEGER) AS quantity,
         unit_price_inr, cost_price_inr AS unit_cost_inr,
         CAST(unit_price_inr * CAST(CASE WHEN l_orderkey % 173 = 0 THEN 0 ELSE l_quantity END AS INTEGER) AS DECIMAL(18,2)) AS item_total_inr,
         CAST((unit_price_inr - cost_price_inr) * CAST(CASE WHEN l_orderkey % 173 = 0 THEN 0 ELSE l_quantity END AS INTEGER) AS DECIMAL(18,2)) AS item_margin_inr,
         l_returnflag = 'R' AS is_substituted, CAST(o_orderdate AS DATE) AS order_date
  FROM lineitem JOIN sku_px ON l_partkey = p_partkey
       JOIN (orders JOIN customer ON o_custkey = c_custkey) ON l_orderkey = o_orderkey),
act_k AS (
  SELECT l.*, s_nationkey,
         CAST((l_orderkey * 7) % 24 AS INTEGER) AS hr, CAST(l_orderkey % 60 AS INTEGER) AS dur,
         CASE WHEN s_acctbal > 6500 THEN CAST(1.25 AS DOUBLE) WHEN s_acctbal > 2500 THEN CAST(1.0 AS DOUBLE)
              ELSE CAST(0.78 AS DOUBLE) END AS eff
  FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey),
fx_picker_activity AS (
  SELECT {LINE_ID('ACT')} AS activity_id, printf('ORD_%08d', l_orderkey) AS order_id,
         printf('PKR_%04d', l_suppkey) AS picker_id, printf('STR_%03d', s_nationkey + 1) AS store_id,
         l_shipdate + INTERVAL 1 HOUR * hr AS pick_start_time,
         l_shipdate + INTERVAL 1 HOUR * hr + INTERVAL 1 MINUTE * dur AS pick_end_time,
         CAST(dur AS DECIMAL(9,2)) AS pick_duration_mins,
         CAST(l_quantity AS INTEGER) AS items_picked,
         {RATE4('CAST(l_quantity AS BIGINT) * 100', 'CAST(dur AS BIGINT) * 100', 'eff')} AS pick_rate_per_min,
         CAST(CASE WHEN l_orderkey % 20 = 0 THEN 2 WHEN l_orderkey % 20 IN (1, 2) THEN 1 ELSE 0 END AS INTEGER) AS errors_made,
         CAST(l_shipdate AS DATE) AS order_date,
         CASE WHEN hr < 12 THEN 'Morning' WHEN hr < 18 THEN 'Afternoon' ELSE 'Night' END AS shift
  FROM act_k),
sub_k AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
         (l_partkey + l_suppkey) % (SELECT COUNT(*) FROM part) AS sub_key
  FROM lineitem WHERE l_returnflag = 'R'),
fx_substitutions AS (
  SELECT {LINE_ID('SUB')} AS substitution_id, printf('ORD_%08d', l_orderkey) AS order_id,
         printf('STR_%03d', s_nationkey + 1) AS store_id,
         printf('SKU_%06d', l_partkey) AS original_sku_id, printf('SKU_%06d', sub_key) AS substitute_sku_id,
         p1.p_type AS original_category, p2.p_type AS substitute_category,
         p1.p_type = p2.p_type AS same_category,
         CAST(p2.unit_price_inr - p1.unit_price_inr AS DECIMAL(18,2)) AS price_difference_inr,
         l_orderkey % 100 < CASE WHEN p1.p_type = p2.p_type THEN 74 ELSE 41 END AS customer_accepted,
         CASE WHEN l_linenumber <= 5 THEN 'Out of Stock' WHEN l_linenumber = 6 THEN 'Damaged' ELSE 'Expired' END AS reason_for_sub,
         CAST(l_shipdate AS DATE) AS order_date
  FROM sub_k JOIN sku_px p1 ON l_partkey = p1.p_partkey JOIN sku_px p2 ON sub_key = p2.p_partkey
       JOIN supplier ON l_suppkey = s_suppkey)"""


ORDER_COLS = ("order_id, store_id, customer_id, order_timestamp, order_date, order_hour, day_of_week, "
              "month, quarter, is_weekend, payment_method, order_value_inr, discount_amount_inr, "
              "delivery_charge_inr, platform_fee_inr, net_order_value_inr, pick_time_mins, pack_time_mins, "
              "dispatch_time_mins, travel_time_mins, total_delivery_mins, sla_met, distance_km, "
              "delivery_cost_inr, order_status, num_items, had_substitution, customer_rating")

_SUM4 = "CAST(pick_time_mins + pack_time_mins + dispatch_time_mins + travel_time_mins AS DECIMAL(9,2))"


def _band(col: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {col} >= {lo} AND {col} < {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {parts} END"


def _band_rc(col: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {parts} END"


_HOUR_BAND = _band("order_hour", [0, 6, 12, 17, 21, 24],
                   ["Late Night", "Morning", "Afternoon", "Evening", "Night"])
_SPEED_BAND = _band("total_delivery_mins", [0, 8, 10, 15, 25, 120],
                    ["<8 mins", "8-10 mins", "10-15 mins", "15-25 mins", ">25 mins"])
_PROD_BAND = _band_rc("least(pick_rate_per_min, CAST(20.0 AS DOUBLE))", [0, 0.8, 1.2, 1.8, 20],
                      ["Low", "Medium", "High", "Elite"])

CLEAN_CTES = f"""
cl_stores AS (
  SELECT * REPLACE ({TITLE('trim(city)')} AS city),
         CAST(date_diff('day', launch_date, DATE '2001-12-31') AS INTEGER) AS store_age_days,
         {RD('CAST(monthly_fixed_cost_inr AS DOUBLE) / store_area_sqft')} AS cost_per_sqft
  FROM fx_stores WHERE monthly_fixed_cost_inr > 0),
sk1 AS (SELECT * FROM fx_skus WHERE unit_price_inr > 0),
sk2 AS (
  SELECT * REPLACE (
    CASE WHEN cost_price_inr >= unit_price_inr THEN {R2('unit_price_inr * 0.80')} ELSE cost_price_inr END AS cost_price_inr,
    CASE WHEN mrp_inr < unit_price_inr THEN {R2('unit_price_inr * 1.10')} ELSE mrp_inr END AS mrp_inr)
  FROM sk1),
sk3 AS (
  SELECT * REPLACE (trim(category) AS category, upper(trim(velocity_class)) AS velocity_class, trim(sku_name) AS sku_name),
         {RD('(CAST(unit_price_inr AS DOUBLE) - CAST(cost_price_inr AS DOUBLE)) / CAST(unit_price_inr AS DOUBLE)', 4)} AS gross_margin_pct_actual
  FROM sk2),
cl_skus AS (SELECT *, gross_margin_pct_actual > 0.30 AS is_high_margin FROM sk3 WHERE shelf_life_days > 0),
cu1 AS (SELECT * FROM fx_customers WHERE signup_date <= DATE '1999-12-31' AND avg_basket_size_inr > 0),
cu_p99 AS (SELECT quantile_cont(CAST(avg_basket_size_inr AS DOUBLE), 0.99) AS p99 FROM cu1),
cu2 AS (
  SELECT cu1.* REPLACE (
    CASE WHEN avg_basket_size_inr > p99 THEN {R2('p99')} ELSE avg_basket_size_inr END AS avg_basket_size_inr,
    greatest(lifetime_orders, 0) AS lifetime_orders, {TITLE('trim(city)')} AS city,
    trim(customer_segment) AS customer_segment, trim(lower(email)) AS email),
    CAST(date_diff('day', signup_date, DATE '1999-12-31') AS INTEGER) AS tenure_days
  FROM cu1, cu_p99),
cl_customers AS (
  SELECT * EXCLUDE (rn_) FROM (
    SELECT *, row_number() OVER (PARTITION BY email ORDER BY customer_id) AS rn_ FROM cu2) WHERE rn_ = 1),
pk1 AS (SELECT * FROM fx_pickers WHERE join_date <= DATE '2001-12-31'),
pk_med AS (SELECT median(CAST(monthly_salary_inr AS DOUBLE)) AS med FROM pk1),
pk2 AS (
  SELECT pk1.* REPLACE (
    CASE WHEN coalesce(monthly_salary_inr BETWEEN 10000 AND 35000, FALSE) THEN monthly_salary_inr
         ELSE CAST(ROUND(CAST(med AS DECIMAL(28,10)), 0) AS BIGINT) END AS monthly_salary_inr)
  FROM pk1, pk_med),
cl_pickers AS (
  SELECT * REPLACE (CAST(floor(date_diff('day', join_date, DATE '2001-12-31') / 30) AS INTEGER) AS experience_months),
         CAST(monthly_salary_inr * 12 AS BIGINT) AS annual_cost_inr
  FROM pk2 WHERE store_id IN (SELECT store_id FROM cl_stores)),
od1 AS (
  SELECT * EXCLUDE (rn_) FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY {ORDER_COLS.replace('order_id, ', '').replace('store_id, customer_id, order_timestamp', 'order_timestamp, store_id, customer_id')}) AS rn_
    FROM fx_orders) WHERE rn_ = 1),
od2 AS (SELECT * FROM od1 WHERE order_value_inr > 0),
od_med AS (
  SELECT median(CAST(pick_time_mins AS DOUBLE)) AS m1, median(CAST(pack_time_mins AS DOUBLE)) AS m2,
         median(CAST(dispatch_time_mins AS DOUBLE)) AS m3, median(CAST(travel_time_mins AS DOUBLE)) AS m4
  FROM od2),
od3 AS (
  SELECT od2.* REPLACE (
    CASE WHEN pick_time_mins < 0 THEN {RM('m1')} ELSE pick_time_mins END AS pick_time_mins,
    CASE WHEN pack_time_mins < 0 THEN {RM('m2')} ELSE pack_time_mins END AS pack_time_mins,
    CASE WHEN dispatch_time_mins < 0 THEN {RM('m3')} ELSE dispatch_time_mins END AS dispatch_time_mins,
    CASE WHEN travel_time_mins < 0 THEN {RM('m4')} ELSE travel_time_mins END AS travel_time_mins)
  FROM od2, od_med),
od_flag AS (SELECT bool_or(abs(total_delivery_mins - {_SUM4}) > 0.5) AS any_disc FROM od3),
od4 AS (
  SELECT od3.* REPLACE (CASE WHEN coalesce(any_disc, FALSE) THEN {_SUM4} ELSE total_delivery_mins END AS total_delivery_mins)
  FROM od3, od_flag),
od5 AS (SELECT * REPLACE (total_delivery_mins <= 10 AS sla_met) FROM od4 WHERE total_delivery_mins <= 120),
cl_orders AS (
  SELECT * REPLACE (CASE WHEN discount_amount_inr >= order_value_inr THEN CAST(0 AS DECIMAL(18,2))
                         ELSE discount_amount_inr END AS discount_amount_inr),
         {R2('net_order_value_inr - delivery_cost_inr')} AS gross_profit_inr,
         {R2('net_order_value_inr - delivery_cost_inr')} > 0 AS is_profitable,
         {_HOUR_BAND} AS order_hour_band,
         {_SPEED_BAND} AS delivery_speed_band
  FROM od5 WHERE store_id IN (SELECT store_id FROM cl_stores)),
cl_order_items AS (
  SELECT * REPLACE (CAST(unit_price_inr * quantity AS DECIMAL(18,2)) AS item_total_inr,
                    CAST((unit_price_inr - unit_cost_inr) * quantity AS DECIMAL(18,2)) AS item_margin_inr),
         {RD('CAST(CAST((unit_price_inr - unit_cost_inr) * quantity AS DECIMAL(18,2)) AS DOUBLE) / CAST(CAST(unit_price_inr * quantity AS DECIMAL(18,2)) AS DOUBLE)', 4)} AS item_margin_pct
  FROM fx_order_items
  WHERE quantity > 0 AND unit_price_inr > 0 AND order_id IN (SELECT order_id FROM cl_orders)),
cl_picker_activity AS (
  SELECT * REPLACE (least(pick_rate_per_min, CAST(20.0 AS DOUBLE)) AS pick_rate_per_min),
         {_PROD_BAND} AS productivity_band
  FROM fx_picker_activity
  WHERE pick_duration_mins > 0 AND picker_id IN (SELECT picker_id FROM cl_pickers)),
cl_substitutions AS (
  SELECT *, CASE WHEN customer_accepted THEN 'Accepted' WHEN NOT customer_accepted THEN 'Rejected' END AS acceptance_label
  FROM fx_substitutions
  WHERE original_sku_id <> substitute_sku_id AND order_id IN (SELECT order_id FROM cl_orders))"""


def with_tables(body: str) -> str:
    """Prefix a query body (referencing fx_* / cl_* names) with all CTEs."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {FIXTURE_CTES},{CLEAN_CTES},\n{body[5:]}"
    return f"WITH {FIXTURE_CTES},{CLEAN_CTES}\n{body}"
