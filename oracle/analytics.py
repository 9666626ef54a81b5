"""Oracle SQL (DuckDB) for the named analytics.  Bodies reference the cleaned
tables ``cl_*`` defined in ``oracle.base``; ``with_tables`` adds the CTEs.

Where the Spark plan uses a rewrite (break-even pre-aggregation, rank after
top-k, distributed rank), the SQL keeps the straightforward form so the
comparison checks the rewrite.
"""

from __future__ import annotations

from oracle.base import MEAN, PCT, RD

DLV = "(SELECT * FROM cl_orders WHERE order_status = 'Delivered')"
MONTH = "CAST(date_trunc('month', order_date) AS DATE)"


def _div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), CAST(0.0 AS DOUBLE)))"


SQL: dict[str, str] = {}

SQL["sla_by_store"] = f"""
SELECT a.*, s.store_name, s.city FROM (
  SELECT store_id, COUNT(order_id) AS total_orders,
         {RD(MEAN('total_delivery_mins'))} AS avg_delivery_mins, {RD(MEAN('pick_time_mins'))} AS avg_pick_mins,
         {RD(MEAN('pack_time_mins'))} AS avg_pack_mins, {RD(MEAN('dispatch_time_mins'))} AS avg_dispatch_mins,
         {RD(MEAN('travel_time_mins'))} AS avg_travel_mins, {RD(PCT('sla_met'))} AS sla_pct,
         {RD(MEAN('distance_km'))} AS avg_distance_km
  FROM {DLV} GROUP BY store_id) a JOIN cl_stores s ON a.store_id = s.store_id"""

SQL["sla_by_hour"] = f"""
SELECT order_hour, COUNT(order_id) AS total_orders, {RD(MEAN('total_delivery_mins'))} AS avg_delivery_mins,
       {RD(PCT('sla_met'))} AS sla_pct, {RD(MEAN('travel_time_mins'))} AS avg_travel_mins,
       {RD(MEAN('pick_time_mins'))} AS avg_pick_mins
FROM {DLV} GROUP BY order_hour"""

SQL["delivery_percentiles"] = f"""
SELECT a.store_id, {RD('p50')} AS p50_delivery, {RD('p75')} AS p75_delivery, {RD('p90')} AS p90_delivery,
       {RD('p95')} AS p95_delivery, total_orders, s.store_name, s.city
FROM (SELECT store_id,
             quantile_cont(CAST(total_delivery_mins AS DOUBLE), 0.5) AS p50,
             quantile_cont(CAST(total_delivery_mins AS DOUBLE), 0.75) AS p75,
             quantile_cont(CAST(total_delivery_mins AS DOUBLE), 0.9) AS p90,
             quantile_cont(CAST(total_delivery_mins AS DOUBLE), 0.95) AS p95,
             COUNT(order_id) AS total_orders
      FROM {DLV} GROUP BY store_id) a JOIN cl_stores s ON a.store_id = s.store_id"""

SQL["weekend_sla"] = f"""
SELECT a.*, s.store_name FROM (
  SELECT store_id, is_weekend, COUNT(order_id) AS total_orders,
         {RD(MEAN('total_delivery_mins'))} AS avg_delivery_mins, {RD(PCT('sla_met'))} AS sla_pct
  FROM {DLV} GROUP BY store_id, is_weekend) a JOIN cl_stores s ON a.store_id = s.store_id"""

SQL["rolling_7day_sla"] = f"""
SELECT store_id, order_date, daily_orders, daily_sla_pct,
       {RD('CAST(SUM(CAST(daily_sla_pct AS DECIMAL(18,2))) OVER w AS DOUBLE) / CAST(COUNT(daily_sla_pct) OVER w AS DOUBLE)')} AS rolling_7day_sla_pct
FROM (SELECT store_id, order_date, COUNT(order_id) AS daily_orders, {RD(PCT('sla_met'))} AS daily_sla_pct
      FROM {DLV} GROUP BY store_id, order_date)
WINDOW w AS (PARTITION BY store_id ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""

SQL["sla_breach_contribution"] = f"""
SELECT a.*, s.store_name FROM (
  SELECT store_id, CASE WHEN sla_met THEN 'SLA Met' ELSE 'SLA Breached' END AS sla_status,
         COUNT(order_id) AS order_count, {RD(MEAN('pick_time_mins'))} AS avg_pick_time,
         {RD(MEAN('pack_time_mins'))} AS avg_pack_time, {RD(MEAN('travel_time_mins'))} AS avg_travel_time,
         {RD(MEAN('total_delivery_mins'))} AS avg_total_delivery
  FROM {DLV} GROUP BY 1, 2) a JOIN cl_stores s ON a.store_id = s.store_id"""

TIME_BAND = ("CASE WHEN order_hour BETWEEN 7 AND 11 THEN 'Morning Peak' WHEN order_hour BETWEEN 12 AND 17 "
             "THEN 'Afternoon' WHEN order_hour BETWEEN 18 AND 21 THEN 'Evening Peak' ELSE 'Off Peak' END")

SQL["hourly_picker_workload"] = f"""
SELECT order_hour, total_orders, {RD('avg_pick')} AS avg_pick_time,
       {RD('CAST(total_orders AS DOUBLE) * avg_pick / 60.0', 1)} AS picker_hours_needed, {TIME_BAND} AS time_band
FROM (SELECT order_hour, COUNT(order_id) AS total_orders, {MEAN('pick_time_mins')} AS avg_pick
      FROM {DLV} GROUP BY order_hour)"""

DAYNUM = ("CASE {c} WHEN 'Monday' THEN 1 WHEN 'Tuesday' THEN 2 WHEN 'Wednesday' THEN 3 WHEN 'Thursday' THEN 4 "
          "WHEN 'Friday' THEN 5 WHEN 'Saturday' THEN 6 WHEN 'Sunday' THEN 7 END")

SQL["dow_demand"] = f"""
SELECT day_of_week, COUNT(order_id) AS total_orders, {RD(MEAN('net_order_value_inr'))} AS avg_order_value,
       {RD(MEAN('total_delivery_mins'))} AS avg_delivery_mins, {RD(PCT('sla_met'))} AS sla_pct,
       {DAYNUM.format(c='day_of_week')} AS day_number
FROM {DLV} GROUP BY day_of_week"""

SQL["sla_flag_counts"] = "SELECT sla_met, COUNT(*) AS row_count FROM cl_orders GROUP BY sla_met"

SQL["delivery_summary"] = f"""
SELECT {RD(MEAN('total_delivery_mins'))} AS avg_delivery, CAST(MIN(total_delivery_mins) AS DOUBLE) AS min_delivery,
       CAST(MAX(total_delivery_mins) AS DOUBLE) AS max_delivery,
       {RD('quantile_cont(CAST(total_delivery_mins AS DOUBLE), 0.5)', 4)} AS median_delivery
FROM {DLV}"""

for _k, _c in (("sla_share", "sla_met"), ("profitable_share", "is_profitable")):
    SQL[_k] = f"""
SELECT {_c}, COUNT(*) AS row_count,
       {RD('CAST(COUNT(*) AS DOUBLE) * 100.0 / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)', 1)} AS pct
FROM cl_orders GROUP BY {_c}"""

SQL["sla_pct_by_store"] = f"""
SELECT a.*, s.store_name FROM (SELECT store_id, {RD(PCT('sla_met'), 1)} AS sla_pct FROM {DLV} GROUP BY store_id) a
JOIN cl_stores s ON a.store_id = s.store_id"""

# ------------------------------------------------------------------ P&L

SQL["monthly_store_pnl"] = f"""
SELECT m.store_id, s.store_name, s.city, m.month, m.total_orders,
       {RD('rev', 0)} AS gross_revenue, {RD('cost', 0)} AS total_delivery_cost, {RD('disc', 0)} AS total_discounts,
       s.monthly_fixed_cost_inr, {RD('gp', 0)} AS gross_profit,
       {RD('CAST(gp AS DOUBLE) - CAST(s.monthly_fixed_cost_inr AS DOUBLE)', 0)} AS net_profit,
       {RD('(CAST(gp AS DOUBLE) - CAST(s.monthly_fixed_cost_inr AS DOUBLE)) / NULLIF(CAST(rev AS DOUBLE), CAST(0.0 AS DOUBLE)) * 100', 2)} AS net_margin_pct
FROM (SELECT store_id, {MONTH} AS month, COUNT(order_id) AS total_orders, SUM(net_order_value_inr) AS rev,
             SUM(delivery_cost_inr) AS cost, SUM(discount_amount_inr) AS disc, SUM(gross_profit_inr) AS gp
      FROM {DLV} GROUP BY 1, 2) m JOIN cl_stores s ON m.store_id = s.store_id"""

PNL_SUMMARY = f"""
SELECT s.store_id, s.store_name, s.city, months_active, {RD('_rev', 0)} AS avg_monthly_revenue,
       {RD('_profit', 0)} AS avg_monthly_profit, s.monthly_fixed_cost_inr AS fixed_cost,
       CASE WHEN _profit > 0 THEN 'PROFITABLE' WHEN _profit > -50000 THEN 'MARGINAL' ELSE 'LOSS MAKING' END AS store_status
FROM (SELECT store_id, COUNT(DISTINCT month) AS months_active, {MEAN('monthly_revenue')} AS _rev,
             {MEAN('monthly_profit')} AS _profit
      FROM (SELECT m.store_id, month, monthly_revenue,
                   CAST(gp - s2.monthly_fixed_cost_inr AS DECIMAL(20,2)) AS monthly_profit
            FROM (SELECT store_id, {MONTH} AS month, SUM(net_order_value_inr) AS monthly_revenue,
                         SUM(gross_profit_inr) AS gp
                  FROM {DLV} GROUP BY 1, 2) m JOIN cl_stores s2 ON m.store_id = s2.store_id)
      GROUP BY store_id) a JOIN cl_stores s ON a.store_id = s.store_id"""
SQL["store_pnl_summary"] = PNL_SUMMARY

# naive fan-out form: every delivered order joined to every order-day of its store
SQL["break_even"] = f"""
SELECT store_id, store_name, city, monthly_fixed_cost_inr, {RD('avg_gp')} AS avg_profit_per_order,
       CAST(ceil(CAST(monthly_fixed_cost_inr AS DOUBLE) / NULLIF(avg_gp, CAST(0.0 AS DOUBLE))) AS BIGINT) AS orders_to_breakeven_monthly,
       CAST(ceil(CAST(monthly_fixed_cost_inr AS DOUBLE) / NULLIF(avg_gp, CAST(0.0 AS DOUBLE)) / 30.0) AS BIGINT) AS orders_to_breakeven_daily,
       {RD('avg_daily', 0)} AS actual_avg_daily_orders,
       CASE WHEN {RD('avg_daily', 0)} >= ceil(CAST(monthly_fixed_cost_inr AS DOUBLE) / NULLIF(avg_gp, CAST(0.0 AS DOUBLE)) / 30.0)
            THEN 'ABOVE BREAKEVEN' ELSE 'BELOW BREAKEVEN' END AS breakeven_status
FROM (SELECT s.store_id, s.store_name, s.city, s.monthly_fixed_cost_inr,
             {MEAN('o.gross_profit_inr')} AS avg_gp, {MEAN('daily.daily_orders', 0)} AS avg_daily
      FROM {DLV} o JOIN cl_stores s ON o.store_id = s.store_id
      JOIN (SELECT store_id, order_date, COUNT(order_id) AS daily_orders FROM {DLV} GROUP BY 1, 2) daily
        ON o.store_id = daily.store_id
      GROUP BY s.store_id, s.store_name, s.city, s.monthly_fixed_cost_inr)"""

SQL["revenue_per_sqft"] = f"""
SELECT s.store_id, s.store_name, s.city, s.store_area_sqft, {RD('rev', 0)} AS total_revenue,
       {RD('CAST(rev AS DOUBLE) / CAST(s.store_area_sqft AS DOUBLE)', 2)} AS revenue_per_sqft,
       CAST(RANK() OVER (ORDER BY rev DESC NULLS LAST) AS BIGINT) AS efficiency_rank
FROM (SELECT store_id, SUM(net_order_value_inr) AS rev FROM {DLV} GROUP BY store_id) a
JOIN cl_stores s ON a.store_id = s.store_id"""

SQL["monthly_growth"] = f"""
SELECT g.store_id, month, monthly_revenue, prev_month_revenue,
       CASE WHEN prev_month_revenue IS NULL THEN NULL
            ELSE {RD('(monthly_revenue - prev_month_revenue) / NULLIF(prev_month_revenue, CAST(0.0 AS DOUBLE)) * 100', 2)} END AS mom_growth_pct,
       s.store_name, s.city
FROM (SELECT store_id, month, monthly_revenue,
             LAG(monthly_revenue) OVER (PARTITION BY store_id ORDER BY month) AS prev_month_revenue
      FROM (SELECT store_id, {MONTH} AS month, {RD('SUM(net_order_value_inr)', 0)} AS monthly_revenue
            FROM {DLV} GROUP BY 1, 2)) g
JOIN cl_stores s ON g.store_id = s.store_id"""

SEGMENT = ("CASE WHEN {n} >= 20 THEN 'Power User' WHEN {n} >= 10 THEN 'Regular' WHEN {n} >= 4 THEN 'Occasional' "
           "ELSE 'One-Time' END")

SQL["customer_segments"] = f"""
SELECT frequency_segment, COUNT(customer_id) AS customer_count, {RD(MEAN('total_orders', 0), 1)} AS avg_orders,
       {RD('AVG(avg_order_value)', 2)} AS avg_order_value, {RD(MEAN('total_spend'), 0)} AS avg_total_spend
FROM (SELECT customer_id, COUNT(order_id) AS total_orders, {MEAN('net_order_value_inr')} AS avg_order_value,
             SUM(net_order_value_inr) AS total_spend, {SEGMENT.format(n='COUNT(order_id)')} AS frequency_segment
      FROM {DLV} GROUP BY customer_id)
GROUP BY frequency_segment"""

STORE_METRICS = f"""
SELECT m.*, s.store_name, s.city,
       CAST(RANK() OVER (ORDER BY _rev DESC NULLS LAST) AS BIGINT) AS revenue_rank,
       CAST(RANK() OVER (ORDER BY _sla DESC NULLS LAST) AS BIGINT) AS sla_rank,
       CAST(RANK() OVER (ORDER BY _gp DESC NULLS LAST) AS BIGINT) AS profit_rank
FROM (SELECT store_id, COUNT(order_id) AS total_orders, SUM(net_order_value_inr) AS _rev,
             {MEAN('total_delivery_mins')} AS _mins, {PCT('sla_met')} AS _sla,
             {MEAN('net_order_value_inr')} AS _aov, {MEAN('gross_profit_inr')} AS _gp
      FROM {DLV} GROUP BY store_id) m JOIN cl_stores s ON m.store_id = s.store_id"""

SCORECARD_COLS = f"""store_id, store_name, city, total_orders,
       {RD('CAST(_rev AS DOUBLE) / 100000.0', 1)} AS revenue_lac, {RD('_mins', 2)} AS avg_delivery_mins,
       {RD('_sla', 1)} AS sla_pct, {RD('_aov', 0)} AS avg_order_value, {RD('_gp', 2)} AS avg_profit_per_order"""
COMPOSITE = RD("CAST(revenue_rank + sla_rank + profit_rank AS DOUBLE) / 3.0", 1)

SQL["store_scorecard"] = f"""
SELECT {SCORECARD_COLS}, revenue_rank, sla_rank, profit_rank, {COMPOSITE} AS composite_rank_score
FROM ({STORE_METRICS})"""

SQL["scorecard_export"] = f"""
SELECT a.store_id, s.store_name, s.city, total_orders, {RD('CAST(_rev AS DOUBLE) / 100000.0', 1)} AS revenue_lac,
       {RD('_mins', 2)} AS avg_delivery_mins, {RD(_div('_met * 100', 'n._net'), 1)} AS network_sla_share_pct,
       {RD('_gp', 2)} AS avg_profit_per_order
FROM (SELECT store_id, COUNT(order_id) AS total_orders, SUM(net_order_value_inr) AS _rev,
             {MEAN('total_delivery_mins')} AS _mins, SUM(CASE WHEN sla_met THEN 1 ELSE 0 END) AS _met,
             {MEAN('gross_profit_inr')} AS _gp
      FROM {DLV} GROUP BY store_id) a
CROSS JOIN (SELECT COUNT(*) AS _net FROM {DLV}) n
JOIN cl_stores s ON a.store_id = s.store_id"""

# ------------------------------------------------------------------ pickers

PER_PICKER = f"""
SELECT picker_id, store_id, COUNT(activity_id) AS total_picks, {MEAN('pick_rate_per_min', 4)} AS _rate,
       {MEAN('pick_duration_mins')} AS _dur, {MEAN('items_picked', 0)} AS _items,
       CAST(SUM(errors_made) AS BIGINT) AS total_errors
FROM cl_picker_activity GROUP BY picker_id, store_id"""

PICKER_PROD = f"""
SELECT q.picker_id, p.picker_name, p.skill_level, p.shift, s.store_name, total_picks,
       {RD('_rate', 3)} AS avg_pick_rate, {RD('_dur', 2)} AS avg_pick_duration, {RD('_items', 1)} AS avg_items_per_order,
       total_errors, {RD(_div('total_errors * 100', 'total_picks'), 2)} AS error_rate_pct,
       CAST(RANK() OVER (ORDER BY _rate DESC NULLS LAST) AS BIGINT) AS productivity_rank
FROM ({PER_PICKER}) q JOIN cl_pickers p ON q.picker_id = p.picker_id JOIN cl_stores s ON q.store_id = s.store_id"""
SQL["picker_productivity"] = PICKER_PROD

SQL["picker_vs_store_avg"] = f"""
SELECT picker_id, picker_name, store_name, skill_level, {RD('picker_avg', 3)} AS picker_avg_rate,
       {RD('store_avg', 3)} AS store_avg_rate, {RD('picker_avg - store_avg', 3)} AS variance_from_store_avg,
       CASE WHEN picker_avg > store_avg * CAST(1.1 AS DOUBLE) THEN 'HIGH PERFORMER'
            WHEN picker_avg < store_avg * CAST(0.9 AS DOUBLE) THEN 'NEEDS COACHING' ELSE 'ON TRACK' END AS performance_flag
FROM (SELECT q.picker_id, p.picker_name, p.skill_level, s.store_name, q._rate AS picker_avg,
             AVG(q._rate) OVER (PARTITION BY q.store_id) AS store_avg
      FROM ({PER_PICKER}) q JOIN cl_pickers p ON q.picker_id = p.picker_id
      JOIN cl_stores s ON q.store_id = s.store_id)"""

SQL["skill_productivity"] = f"""
SELECT skill_level, {RD(_div('SUM(_r)', 'SUM(_n)'), 4)} AS avg_pick_rate,
       {RD(_div('SUM(_d)', 'SUM(_n)'), 2)} AS avg_pick_duration, {RD(_div('SUM(_i)', 'SUM(_n)'), 2)} AS avg_items_picked,
       CAST(SUM(_n) AS BIGINT) AS total_activities
FROM (SELECT picker_id, SUM(CAST(pick_rate_per_min AS DECIMAL(18,4))) AS _r, SUM(pick_duration_mins) AS _d,
             SUM(items_picked) AS _i, COUNT(*) AS _n
      FROM cl_picker_activity GROUP BY picker_id) a
LEFT JOIN (SELECT picker_id, skill_level FROM cl_pickers) p ON a.picker_id = p.picker_id
GROUP BY skill_level"""

SQL["shift_productivity"] = f"""
SELECT shift, {RD(MEAN('pick_rate_per_min', 4), 4)} AS avg_pick_rate, {RD(MEAN('errors_made', 0), 4)} AS error_rate,
       COUNT(*) AS total_activities
FROM cl_picker_activity GROUP BY shift"""

SQL["store_pick_rate"] = f"""
SELECT a.store_id, s.store_name, {RD('_r', 4)} AS avg_pick_rate, {RD('AVG(_r) OVER ()', 4)} AS network_avg_pick_rate
FROM (SELECT store_id, {MEAN('pick_rate_per_min', 4)} AS _r FROM cl_picker_activity GROUP BY store_id) a
JOIN cl_stores s ON a.store_id = s.store_id"""

SQL["picker_bands"] = f"""
SELECT picker_id, picker_name, skill_level, shift, store_name, total_picks, avg_pick_rate, total_errors, error_rate_pct,
       {RD('net', 4)} AS network_avg_rate,
       CASE WHEN avg_pick_rate >= net * CAST(1.1 AS DOUBLE) THEN 'green'
            WHEN avg_pick_rate < net * CAST(0.9 AS DOUBLE) THEN 'red' ELSE 'none' END AS rate_band,
       error_rate_pct > 10.0 AS high_error_flag
FROM (SELECT *, AVG(avg_pick_rate) OVER () AS net FROM ({PICKER_PROD}))"""

SQL["pick_rate_by_store_skill_shift"] = f"""
SELECT CASE WHEN store_name IS NOT NULL THEN 'store' WHEN skill_level IS NOT NULL THEN 'skill_level' ELSE 'shift' END AS axis,
       coalesce(store_name, skill_level, shift) AS axis_value,
       {RD(_div('SUM(_r)', 'SUM(_n)'), 4)} AS avg_pick_rate, CAST(SUM(_n) AS BIGINT) AS activities
FROM (SELECT a.shift, a._r, a._n, p.skill_level, s.store_name
      FROM (SELECT picker_id, store_id, shift, SUM(CAST(pick_rate_per_min AS DECIMAL(18,4))) AS _r, COUNT(*) AS _n
            FROM cl_picker_activity GROUP BY 1, 2, 3) a
      JOIN cl_pickers p ON a.picker_id = p.picker_id JOIN cl_stores s ON a.store_id = s.store_id)
GROUP BY GROUPING SETS ((store_name), (skill_level), (shift))"""

SQL["picker_concentration"] = f"""
SELECT CAST(MAX(n) AS BIGINT) AS n_pickers,
       CAST(SUM(CASE WHEN rk <= ceil(n * 0.10) THEN 1 ELSE 0 END) AS BIGINT) AS top_pickers,
       CAST(SUM(CASE WHEN rk <= ceil(n * 0.10) THEN picks ELSE 0 END) AS BIGINT) AS top_picks,
       CAST(MAX(tot) AS BIGINT) AS total_picks,
       {RD(_div('SUM(CASE WHEN rk <= ceil(n * 0.10) THEN picks ELSE 0 END) * 100', 'MAX(tot)'), 2)} AS top_share_pct
FROM (SELECT picks, RANK() OVER (ORDER BY picks DESC) AS rk, COUNT(*) OVER () AS n, SUM(picks) OVER () AS tot
      FROM (SELECT picker_id, COUNT(*) AS picks FROM cl_picker_activity GROUP BY picker_id))"""

SQL["error_vs_experience"] = f"""
SELECT COUNT(*) AS n_pickers, {RD("corr(_err, CAST(p.experience_months AS DOUBLE))", 6)} AS corr_error_experience
FROM (SELECT picker_id, {_div('SUM(errors_made) * 100', 'COUNT(*)')} AS _err
      FROM cl_picker_activity GROUP BY picker_id) a JOIN cl_pickers p ON a.picker_id = p.picker_id"""

# ------------------------------------------------------------------ products

SQL["top_skus"] = f"""
SELECT sku_name, category, velocity_class, orders_containing_sku, total_qty_sold, total_revenue, total_margin,
       avg_margin_pct, revenue_rank
FROM (SELECT k.sku_name, k.category, k.velocity_class, COUNT(DISTINCT i.order_id) AS orders_containing_sku,
             CAST(SUM(i.quantity) AS BIGINT) AS total_qty_sold, {RD('SUM(i.item_total_inr)', 0)} AS total_revenue,
             {RD('SUM(i.item_margin_inr)', 0)} AS total_margin, {RD(MEAN('i.item_margin_pct', 4), 3)} AS avg_margin_pct,
             CAST(RANK() OVER (ORDER BY SUM(i.item_total_inr) DESC) AS BIGINT) AS revenue_rank,
             SUM(i.item_total_inr) AS _rev
      FROM cl_order_items i JOIN cl_skus k ON i.sku_id = k.sku_id
      GROUP BY k.sku_name, k.category, k.velocity_class)
ORDER BY _rev DESC, sku_name, category, velocity_class LIMIT 20"""

SQL["category_by_store"] = f"""
SELECT c.store_id, s.store_name, s.city, category, orders, total_qty, {RD('_rev', 0)} AS revenue,
       {RD(RD('_rev', 0) + ' * 100.0 / NULLIF(CAST(SUM(_rev) OVER (PARTITION BY c.store_id) AS DOUBLE), CAST(0.0 AS DOUBLE))', 2)} AS revenue_share_pct
FROM (SELECT store_id, category, COUNT(DISTINCT order_id) AS orders, CAST(SUM(quantity) AS BIGINT) AS total_qty,
             SUM(item_total_inr) AS _rev
      FROM cl_order_items GROUP BY store_id, category) c JOIN cl_stores s ON c.store_id = s.store_id"""

CATEGORY_PERF = f"""
SELECT category, CAST(SUM(quantity) AS BIGINT) AS total_qty, {RD('SUM(item_total_inr)', 0)} AS total_revenue,
       {RD('SUM(item_margin_inr)', 0)} AS total_margin, {RD(MEAN('item_margin_pct', 4) + ' * 100', 1)} AS avg_margin_pct
FROM cl_order_items GROUP BY category"""
SQL["category_performance"] = CATEGORY_PERF

SQL["category_summary"] = f"""
WITH q_cat AS (
  SELECT category, SUM(item_total_inr) AS _rev, SUM(item_margin_inr) AS _m, CAST(SUM(quantity) AS BIGINT) AS total_qty,
         COUNT(DISTINCT order_id) AS order_count
  FROM cl_order_items GROUP BY category),
q_out AS (
  SELECT category, {RD('_rev', 2)} AS total_revenue, {RD('_m', 2)} AS total_margin, total_qty, order_count,
         {RD(_div('_m', '_rev') + ' * 100', 1)} AS margin_pct, {RD('CAST(_rev AS DOUBLE) / 100000.0', 1)} AS revenue_lac,
         {RD(_div('_rev', 'SUM(_rev) OVER ()') + ' * 100', 1)} AS revenue_share,
         {RD(_div('total_qty', 'MAX(total_qty) OVER ()'), 4)} AS volume_rel_max
  FROM q_cat)
SELECT *, (SELECT {RD(MEAN('margin_pct', 1), 2)} FROM q_out) AS mean_margin_pct FROM q_out"""

SQL["category_margin_bands"] = f"""
SELECT *, CASE WHEN avg_margin_pct >= 25.0 THEN 'green' WHEN avg_margin_pct < 18.0 THEN 'red' ELSE 'amber' END AS margin_band
FROM ({CATEGORY_PERF})"""

SQL["velocity_contribution"] = f"""
SELECT velocity_class, {RD('_rev', 0)} AS revenue, {RD('_m', 0)} AS margin,
       {RD(_div('_rev', 'SUM(_rev) OVER ()') + ' * 100', 1)} AS revenue_share_pct,
       {RD(_div('_m', 'SUM(_m) OVER ()') + ' * 100', 1)} AS margin_share_pct
FROM (SELECT k.velocity_class, SUM(i.item_total_inr) AS _rev, SUM(i.item_margin_inr) AS _m
      FROM cl_order_items i JOIN cl_skus k ON i.sku_id = k.sku_id GROUP BY k.velocity_class)"""

# ------------------------------------------------------------------ substitutions

ACC = RD(PCT("customer_accepted"))

SQL["substitution_acceptance"] = f"""
SELECT original_category, same_category, reason_for_sub, COUNT(substitution_id) AS total_substitutions,
       CAST(SUM(CASE WHEN customer_accepted THEN 1 ELSE 0 END) AS BIGINT) AS accepted_count,
       {ACC} AS acceptance_rate_pct, {RD(MEAN('price_difference_inr'))} AS avg_price_diff
FROM cl_substitutions GROUP BY 1, 2, 3"""

SQL["sku_stockout"] = f"""
SELECT k.sku_name, k.category, k.velocity_class, COUNT(x.substitution_id) AS times_substituted,
       {RD(_div('SUM(CASE WHEN x.customer_accepted = FALSE THEN 1 ELSE 0 END) * 100', 'COUNT(x.substitution_id)'), 2)} AS rejection_rate_pct,
       {RD(_div('COUNT(x.substitution_id) * 100', "(SELECT COUNT(*) FROM cl_orders WHERE order_status = 'Delivered')"), 4)} AS sub_rate_per_order_pct
FROM cl_substitutions x JOIN cl_skus k ON x.original_sku_id = k.sku_id
GROUP BY k.sku_name, k.category, k.velocity_class
ORDER BY times_substituted DESC, k.sku_name, k.category, k.velocity_class LIMIT 20"""

SQL["acceptance_by_match"] = f"""
SELECT same_category, {ACC} AS acceptance_rate, COUNT(substitution_id) AS total_subs,
       CASE WHEN same_category THEN 'Same Category' WHEN NOT same_category THEN 'Different Category' END AS match_type
FROM cl_substitutions GROUP BY same_category"""

SQL["acceptance_by_reason"] = f"""
SELECT reason_for_sub, {ACC} AS acceptance_rate, COUNT(substitution_id) AS total_subs
FROM cl_substitutions GROUP BY reason_for_sub"""

SQL["acceptance_by_category"] = f"""
SELECT original_category, {ACC} AS acceptance_rate, COUNT(substitution_id) AS total_subs,
       (SELECT {ACC} FROM cl_substitutions) AS overall_acceptance_rate
FROM cl_substitutions GROUP BY original_category"""

SUB_BANDS = f"""
SELECT *, CASE WHEN acceptance_rate_pct >= 70.0 THEN 'green' WHEN acceptance_rate_pct < 50.0 THEN 'red' ELSE 'amber' END AS acceptance_band
FROM (SELECT original_category, same_category, reason_for_sub, COUNT(substitution_id) AS total_subs,
             {ACC} AS acceptance_rate_pct
      FROM cl_substitutions GROUP BY 1, 2, 3)"""
SQL["substitution_bands"] = SUB_BANDS

SQL["substitution_share"] = f"""
SELECT acceptance_label, COUNT(*) AS row_count, {RD(_div('COUNT(*) * 100', 'SUM(COUNT(*)) OVER ()'), 1)} AS pct
FROM cl_substitutions GROUP BY acceptance_label"""

# ------------------------------------------------------------------ exploratory

SQL["business_kpis"] = f"""
SELECT COUNT(*) AS total_orders, {RD('SUM(net_order_value_inr)', 2)} AS total_revenue,
       {RD('SUM(gross_profit_inr)', 2)} AS total_profit, {RD(MEAN('net_order_value_inr'), 2)} AS avg_order_value,
       {RD(MEAN('total_delivery_mins'), 2)} AS avg_delivery_mins, {RD(PCT('sla_met'), 2)} AS sla_pct,
       {RD(PCT('is_profitable'), 2)} AS profitable_pct, COUNT(DISTINCT customer_id) AS unique_customers,
       {RD(PCT("order_status = 'Cancelled'"), 2)} AS cancellation_rate, {RD(PCT("order_status = 'RTO'"), 2)} AS rto_rate
FROM cl_orders"""

SQL["monthly_trend"] = f"""
SELECT month, total_orders, {RD('_rev', 2)} AS total_revenue, avg_delivery, sla_pct,
       {RD('CAST(_rev AS DOUBLE) / 100000.0', 2)} AS revenue_lac,
       ROW_NUMBER() OVER (ORDER BY total_orders DESC, month) = 1 AS is_peak_month
FROM (SELECT {MONTH} AS month, COUNT(order_id) AS total_orders, SUM(net_order_value_inr) AS _rev,
             {RD(MEAN('total_delivery_mins'), 2)} AS avg_delivery, {RD(PCT('sla_met'), 2)} AS sla_pct
      FROM cl_orders GROUP BY 1)"""

STORE_SLA = f"""
SELECT store_id, COUNT(order_id) AS total_orders, {PCT('sla_met')} AS _met, {MEAN('total_delivery_mins')} AS _d,
       {MEAN('pick_time_mins')} AS _p, {MEAN('travel_time_mins')} AS _t
FROM cl_orders GROUP BY store_id"""

SQL["store_sla_bands"] = f"""
SELECT a.store_id, s.store_name, s.city, total_orders, {RD('_met', 2)} AS sla_met_pct, {RD('100.0 - _met', 2)} AS sla_fail_pct,
       {RD('_d', 2)} AS avg_delivery, {RD('_p', 2)} AS avg_pick_time, {RD('_t', 2)} AS avg_travel_time,
       CASE WHEN _met < 80.0 THEN 'red' WHEN _met < 88.0 THEN 'amber' ELSE 'green' END AS sla_band
FROM ({STORE_SLA}) a JOIN cl_stores s ON a.store_id = s.store_id"""

SQL["demand_heatmap"] = ("SELECT dayname(order_date) AS day_name, "
                         + ", ".join(f"CAST(SUM(CASE WHEN order_hour = {h} THEN 1 END) AS BIGINT) AS h{h:02d}"
                                     for h in range(24))
                         + f", {DAYNUM.format(c='dayname(order_date)')} AS day_number FROM cl_orders GROUP BY 1")

PNL_ESTIMATE = f"""
SELECT q.*, s.store_name, s.city, s.monthly_fixed_cost_inr, _avg * CAST(0.38 AS DOUBLE) AS _var,
       _avg - _avg * CAST(0.38 AS DOUBLE) - CAST(s.monthly_fixed_cost_inr AS DOUBLE) AS _profit
FROM (SELECT store_id, {MEAN('_mrev')} AS _avg, SUM(_mrev) AS _tot, COUNT(DISTINCT month) AS months_active
      FROM (SELECT store_id, {MONTH} AS month, SUM(net_order_value_inr) AS _mrev FROM {DLV} GROUP BY 1, 2)
      GROUP BY store_id) q JOIN cl_stores s ON q.store_id = s.store_id"""

SQL["store_pnl_estimate"] = f"""
SELECT store_id, store_name, city, monthly_fixed_cost_inr, months_active, {RD('_avg', 2)} AS avg_monthly_revenue,
       {RD('_tot', 2)} AS total_revenue, {RD('_var', 2)} AS avg_variable_cost, {RD('_profit', 2)} AS avg_monthly_profit,
       {RD(_div('_profit', '_avg') + ' * 100', 2)} AS profit_margin_pct, _profit > 0 AS is_profitable,
       {RD('CAST(monthly_fixed_cost_inr AS DOUBLE) / (CAST(1 AS DOUBLE) - CAST(0.38 AS DOUBLE))', 0)} AS breakeven_monthly_revenue
FROM ({PNL_ESTIMATE})"""

SQL["eda_findings"] = f"""
SELECT * FROM
 (SELECT CAST(SUM(CASE WHEN _met < 80.0 THEN 1 ELSE 0 END) AS BIGINT) AS stores_below_80_sla,
         first(store_name ORDER BY _met DESC, a.store_id) AS best_sla_store,
         first(store_name ORDER BY _met ASC, a.store_id) AS worst_sla_store
  FROM ({STORE_SLA}) a JOIN cl_stores s ON a.store_id = s.store_id) f1,
 (SELECT CAST(SUM(CASE WHEN _profit > 0 THEN 1 ELSE 0 END) AS BIGINT) AS profitable_stores,
         COUNT(*) AS stores_with_revenue,
         first(store_name ORDER BY _profit DESC, store_id) AS best_profit_store,
         first(store_name ORDER BY _profit ASC, store_id) AS worst_profit_store
  FROM ({PNL_ESTIMATE})) f2,
 (SELECT {RD(PCT('customer_accepted'), 1)} AS overall_acceptance_pct,
         {RD(PCT('customer_accepted AND same_category', 'SUM(CASE WHEN same_category THEN 1 ELSE 0 END)'), 1)} AS same_category_acceptance_pct,
         {RD(PCT('customer_accepted AND NOT same_category', 'SUM(CASE WHEN NOT same_category THEN 1 ELSE 0 END)'), 1)} AS diff_category_acceptance_pct
  FROM cl_substitutions) f3"""

# ------------------------------------------------------------------ reports

SCORECARD_AOV = f"SELECT {SCORECARD_COLS}, {COMPOSITE} AS composite_rank_score FROM ({STORE_METRICS})"

SQL["executive_kpis"] = f"""
WITH q_sc AS (
  SELECT {RD('SUM(revenue_lac)', 1)} AS total_revenue_lakh, CAST(SUM(total_orders) AS DOUBLE) AS total_orders,
         AVG(sla_pct) AS network_sla_pct, AVG(avg_delivery_mins) AS avg_delivery_mins,
         {RD('AVG(avg_order_value)', 0)} AS avg_order_value
  FROM ({SCORECARD_AOV})),
q_pn AS (SELECT CAST(SUM(CASE WHEN store_status = 'PROFITABLE' THEN 1 ELSE 0 END) AS DOUBLE) AS profitable_stores
         FROM ({PNL_SUMMARY}))
SELECT 'total_revenue_lakh' AS kpi, total_revenue_lakh AS value, 'info' AS status FROM q_sc
UNION ALL SELECT 'total_orders', total_orders, 'info' FROM q_sc
UNION ALL SELECT 'network_sla_pct', {RD('network_sla_pct', 2)}, CASE WHEN network_sla_pct >= 85.0 THEN 'green' ELSE 'red' END FROM q_sc
UNION ALL SELECT 'avg_delivery_mins', {RD('avg_delivery_mins', 2)}, CASE WHEN avg_delivery_mins <= 10.0 THEN 'green' ELSE 'amber' END FROM q_sc
UNION ALL SELECT 'avg_order_value', avg_order_value, 'info' FROM q_sc
UNION ALL SELECT 'profitable_stores', profitable_stores, CASE WHEN profitable_stores >= 7 THEN 'green' ELSE 'red' END FROM q_pn"""

SQL["store_status_summary"] = f"SELECT store_status, COUNT(*) AS store_count FROM ({PNL_SUMMARY}) GROUP BY store_status"

SQL["scorecard_bands"] = f"""
SELECT *, CASE WHEN composite_rank_score <= 3.0 THEN 'green' WHEN composite_rank_score <= 6.0 THEN 'amber' ELSE 'red' END AS composite_band,
       CASE WHEN sla_pct >= 88.0 THEN 'green' WHEN sla_pct >= 80.0 THEN 'amber' ELSE 'red' END AS sla_band
FROM ({SCORECARD_AOV})"""

SLA_SLIM = f"""
SELECT a.*, s.store_name, s.city FROM (
  SELECT store_id, COUNT(order_id) AS total_orders, {RD(MEAN('total_delivery_mins'))} AS avg_delivery_mins,
         {RD(MEAN('pick_time_mins'))} AS avg_pick_mins, {RD(MEAN('travel_time_mins'))} AS avg_travel_mins,
         {RD(PCT('sla_met'))} AS sla_pct
  FROM {DLV} GROUP BY store_id) a JOIN cl_stores s ON a.store_id = s.store_id"""

SQL["sla_bands"] = f"""
SELECT *, CASE WHEN sla_pct >= 88.0 THEN 'On Target' WHEN sla_pct >= 80.0 THEN 'Warning' ELSE 'Critical' END AS sla_status
FROM ({SLA_SLIM})"""

HOURLY = f"""
SELECT order_hour, COUNT(order_id) AS total_orders, {RD(MEAN('total_delivery_mins'))} AS avg_delivery_mins,
       {RD(PCT('sla_met'))} AS sla_pct
FROM {DLV} GROUP BY order_hour"""

SQL["hourly_peak_bands"] = f"""
SELECT h.*, CASE WHEN total_orders >= {RD('q90', 6)} THEN 'peak' WHEN total_orders >= {RD('q75', 6)} THEN 'busy' ELSE 'normal' END AS demand_band,
       {RD('q75', 2)} AS p75_orders, {RD('q90', 2)} AS p90_orders
FROM ({HOURLY}) h CROSS JOIN (SELECT quantile_cont(CAST(total_orders AS DOUBLE), 0.75) AS q75,
                                     quantile_cont(CAST(total_orders AS DOUBLE), 0.9) AS q90 FROM ({HOURLY}))"""

SQL["key_findings"] = f"""
SELECT * FROM
 (SELECT *, {RD('88.0 - avg_sla_pct', 2)} AS sla_gap_to_target FROM
   (SELECT first(store_name ORDER BY sla_pct DESC, store_id) AS best_sla_store, MAX(sla_pct) AS best_sla_pct,
           first(store_name ORDER BY sla_pct ASC, store_id) AS worst_sla_store, MIN(sla_pct) AS worst_sla_pct,
           {RD('AVG(sla_pct)', 2)} AS avg_sla_pct
    FROM ({SLA_SLIM}))) f1,
 (SELECT CAST(SUM(CASE WHEN store_status = 'PROFITABLE' THEN 1 ELSE 0 END) AS BIGINT) AS profitable_stores,
         CAST(SUM(CASE WHEN store_status = 'MARGINAL' THEN 1 ELSE 0 END) AS BIGINT) AS marginal_stores,
         CAST(SUM(CASE WHEN store_status = 'LOSS MAKING' THEN 1 ELSE 0 END) AS BIGINT) AS loss_making_stores
  FROM ({PNL_SUMMARY})) f2,
 (SELECT first(category ORDER BY total_revenue DESC, category) AS top_category,
         first(total_revenue ORDER BY total_revenue DESC, category) AS top_category_revenue,
         first(avg_margin_pct ORDER BY total_revenue DESC, category) AS top_category_margin_pct
  FROM ({CATEGORY_PERF})) f3,
 (SELECT first(picker_name ORDER BY avg_pick_rate DESC, picker_id) AS top_picker,
         MAX(avg_pick_rate) AS top_pick_rate, {RD('AVG(avg_pick_rate)', 3)} AS avg_pick_rate,
         {RD('(MAX(avg_pick_rate) / AVG(avg_pick_rate) - 1) * 100', 1)} AS top_picker_uplift_pct
  FROM ({PICKER_PROD})) f4,
 (SELECT first(original_category ORDER BY acceptance_rate_pct DESC, original_category, same_category, reason_for_sub) AS best_sub_category,
         MAX(acceptance_rate_pct) AS best_sub_pct,
         first(original_category ORDER BY acceptance_rate_pct ASC, original_category, same_category, reason_for_sub) AS worst_sub_category,
         MIN(acceptance_rate_pct) AS worst_sub_pct
  FROM ({SUB_BANDS})) f5,
 (SELECT first(order_hour ORDER BY total_orders DESC, order_hour) AS peak_hour, MAX(total_orders) AS peak_orders
  FROM ({HOURLY})) f6"""

SQL["orders_by_city"] = """
SELECT s.city, CAST(COUNT(*) AS BIGINT) AS total_orders FROM cl_orders o JOIN cl_stores s ON o.store_id = s.store_id
GROUP BY s.city"""

SQL["order_status_share"] = f"""
SELECT order_status, COUNT(*) AS row_count, {RD(_div('COUNT(*) * 100', 'SUM(COUNT(*)) OVER ()'), 1)} AS pct
FROM cl_orders GROUP BY order_status"""

SQL["revenue_vs_delivery_cost"] = f"""
SELECT a.*, s.store_name FROM (
  SELECT store_id, {RD('SUM(net_order_value_inr)', 0)} AS revenue, {RD('SUM(delivery_cost_inr)', 0)} AS delivery_cost
  FROM {DLV} GROUP BY store_id) a JOIN cl_stores s ON a.store_id = s.store_id"""

SQL["slice_orders"] = f"""
SELECT a.*, s.store_name, s.city FROM (
  SELECT store_id, COUNT(order_id) AS total_orders,
         {RD(MEAN('total_delivery_mins'))} AS avg_delivery_mins, {RD(MEAN('pick_time_mins'))} AS avg_pick_mins,
         {RD(MEAN('pack_time_mins'))} AS avg_pack_mins, {RD(MEAN('dispatch_time_mins'))} AS avg_dispatch_mins,
         {RD(MEAN('travel_time_mins'))} AS avg_travel_mins, {RD(PCT('sla_met'))} AS sla_pct,
         {RD(MEAN('distance_km'))} AS avg_distance_km
  FROM {DLV}
  WHERE store_id IN (SELECT store_id FROM cl_stores WHERE city = 'Asia')
    AND order_date >= DATE '1996-01-01' AND order_date <= DATE '1998-12-31'
  GROUP BY store_id) a JOIN cl_stores s ON a.store_id = s.store_id"""

SQL["slice_store"] = SQL["slice_orders"].replace(
    """WHERE store_id IN (SELECT store_id FROM cl_stores WHERE city = 'Asia')
    AND order_date >= DATE '1996-01-01' AND order_date <= DATE '1998-12-31'""", "WHERE store_id = 'STR_003'")


def _sliced_pickers(condition: str) -> str:
    return PICKER_PROD.replace("cl_pickers", f"(SELECT * FROM cl_pickers WHERE {condition})")


SQL["slice_skill"] = _sliced_pickers("skill_level = 'Expert'")
SQL["slice_shift"] = _sliced_pickers("shift = 'Morning'")

SQL["slice_months"] = SQL["delivery_percentiles"].replace(
    DLV, f"(SELECT * FROM {DLV} WHERE order_date >= DATE '1995-04-01' AND order_date <= DATE '1996-09-30')")
SQL["slice_hours"] = SQL["hourly_peak_bands"].replace(
    DLV, f"(SELECT * FROM {DLV} WHERE store_id IN (SELECT store_id FROM cl_stores WHERE city = 'Asia'))")
