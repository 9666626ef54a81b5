"""Reports as SQL text over the views of a table set.

``run_sql`` registers the tables as temporary views and the numeric contract as SQL functions, and
gives the result of any statement as a DataFrame.  ``REPORTS`` holds the reports that the business
writes as SQL.  The text is resolved when it is given, so another table set's views registered
afterwards do not change a result that has not been read yet.

A mean is ``safe_div(sum(exact_amount(x)), count(x))``: an exact decimal sum over a count.
"""

from __future__ import annotations

import re
from threading import Lock

from pyspark.sql import DataFrame

from storepulse.functions.sql import register_functions
from storepulse.sources.tables import register_views

#: Views are named in the session; of concurrent callers one at a time registers them and resolves its text.
_RESOLVING = Lock()


def run_sql(T: dict[str, DataFrame], text: str, args: dict | list | None = None) -> DataFrame:
    """The result of a SQL statement over the tables by their names.

    ``args`` are bound to the markers of the text (``:name`` or ``?``), never pasted into it."""
    named = {n: T[n] for n in T if re.search(rf"\b{re.escape(n)}\b", text, re.IGNORECASE)} or dict(T)      # no other need be built
    spark = next(iter(named.values())).sparkSession
    with _RESOLVING:
        register_views(named)
        register_functions(spark)
        return spark.sql(text, args=args)


REPORTS: dict[str, str] = {}

REPORTS["sql_sla_by_store"] = """
SELECT o.*, s.store_name, s.city
FROM (SELECT store_id, COUNT(order_id) AS total_orders,
             exact_round(safe_div(SUM(exact_amount(total_delivery_mins)), COUNT(total_delivery_mins)), 2) AS avg_delivery_mins,
             exact_round(safe_div(SUM(exact_amount(pick_time_mins)), COUNT(pick_time_mins)), 2) AS avg_pick_mins,
             exact_round(safe_div(SUM(exact_amount(pack_time_mins)), COUNT(pack_time_mins)), 2) AS avg_pack_mins,
             exact_round(safe_div(SUM(exact_amount(dispatch_time_mins)), COUNT(dispatch_time_mins)), 2) AS avg_dispatch_mins,
             exact_round(safe_div(SUM(exact_amount(travel_time_mins)), COUNT(travel_time_mins)), 2) AS avg_travel_mins,
             exact_round(share_pct(COUNT_IF(sla_met), COUNT(*)), 2) AS sla_pct,
             exact_round(safe_div(SUM(exact_amount(distance_km)), COUNT(distance_km)), 2) AS avg_distance_km
      FROM fact_orders WHERE order_status = 'Delivered' GROUP BY store_id) o
JOIN dim_stores s ON o.store_id = s.store_id
ORDER BY sla_pct, o.store_id"""

REPORTS["sql_store_pnl_summary"] = """
WITH months AS (
  SELECT store_id, TRUNC(order_date, 'month') AS month, SUM(net_order_value_inr) AS revenue, SUM(gross_profit_inr) AS profit
  FROM fact_orders WHERE order_status = 'Delivered' GROUP BY 1, 2),
stores AS (
  SELECT m.store_id, COUNT(DISTINCT m.month) AS months_active,
         safe_div(SUM(CAST(m.revenue AS DECIMAL(20,2))), COUNT(m.revenue)) AS revenue,
         safe_div(SUM(CAST(m.profit - s.monthly_fixed_cost_inr AS DECIMAL(20,2))), COUNT(m.profit)) AS profit
  FROM months m JOIN dim_stores s ON m.store_id = s.store_id GROUP BY m.store_id)
SELECT a.store_id, s.store_name, s.city, a.months_active, exact_round(a.revenue, 0) AS avg_monthly_revenue,
       exact_round(a.profit, 0) AS avg_monthly_profit, s.monthly_fixed_cost_inr AS fixed_cost,
       pnl_status(a.profit) AS store_status
FROM stores a JOIN dim_stores s ON a.store_id = s.store_id
ORDER BY avg_monthly_profit DESC, a.store_id"""

REPORTS["sql_monthly_growth"] = """
WITH months AS (
  SELECT store_id, TRUNC(order_date, 'month') AS month, exact_round(SUM(net_order_value_inr), 0) AS monthly_revenue
  FROM fact_orders WHERE order_status = 'Delivered' GROUP BY 1, 2),
steps AS (
  SELECT *, LAG(monthly_revenue) OVER (PARTITION BY store_id ORDER BY month) AS prev_month_revenue FROM months)
SELECT g.store_id, g.month, g.monthly_revenue, g.prev_month_revenue,
       exact_round(safe_div(g.monthly_revenue - g.prev_month_revenue, g.prev_month_revenue) * 100, 2) AS mom_growth_pct,
       s.store_name, s.city
FROM steps g JOIN dim_stores s ON g.store_id = s.store_id
ORDER BY s.store_name, g.month"""

REPORTS["sql_substitution_acceptance"] = """
SELECT original_category, same_category, reason_for_sub, COUNT(substitution_id) AS total_substitutions,
       COUNT_IF(customer_accepted) AS accepted_count,
       exact_round(share_pct(COUNT_IF(customer_accepted), COUNT(*)), 2) AS acceptance_rate_pct,
       exact_round(safe_div(SUM(exact_amount(price_difference_inr)), COUNT(price_difference_inr)), 2) AS avg_price_diff
FROM fact_substitutions GROUP BY original_category, same_category, reason_for_sub
ORDER BY acceptance_rate_pct DESC, original_category, same_category, reason_for_sub"""


def report(name: str):
    """The report of this name as a function of a table set."""
    return lambda T: run_sql(T, REPORTS[name])
