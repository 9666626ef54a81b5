"""Query registry: key → ``fn(spark, sf_dir) -> DataFrame``.

Every query reads the cleaned set, which is derived from the driver tables under
``sf_dir`` and stored when a query first asks for it, or the raw or updated set likewise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storepulse.plans import explore, operator_queries, pickers, pnl, products, reports, sla, sql_reports, substitutions
from storepulse.plans.tableset import clean_set

QueryFn = Callable[[SparkSession, str], DataFrame]


def _on_clean(fn, **params) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(clean_set(spark, sf_dir), **params)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


ANALYTICS: dict[str, Callable] = {
    # delivery / SLA
    "sla_by_store": sla.sla_by_store,
    "sla_by_hour": sla.sla_by_hour,
    "delivery_percentiles": sla.delivery_percentiles,
    "weekend_sla": sla.weekend_sla,
    "rolling_7day_sla": sla.rolling_7day_sla,
    "sla_breach_contribution": sla.sla_breach_contribution,
    "hourly_picker_workload": sla.hourly_picker_workload,
    "dow_demand": sla.dow_demand,
    "sla_flag_counts": sla.sla_flag_counts,
    "delivery_summary": sla.delivery_summary,
    "sla_share": sla.sla_share,
    "profitable_share": sla.profitable_share,
    "sla_pct_by_store": sla.sla_pct_by_store,
    # P&L, growth, customers, scorecard
    "monthly_store_pnl": pnl.monthly_store_pnl,
    "store_pnl_summary": pnl.store_pnl_summary,
    "break_even": pnl.break_even,
    "revenue_per_sqft": pnl.revenue_per_sqft,
    "monthly_growth": pnl.monthly_growth,
    "customer_segments": pnl.customer_segments,
    "store_scorecard": pnl.store_scorecard,
    "scorecard_export": pnl.scorecard_export,
    # pickers
    "picker_productivity": pickers.picker_productivity,
    "picker_vs_store_avg": pickers.picker_vs_store_avg,
    "skill_productivity": pickers.skill_productivity,
    "shift_productivity": pickers.shift_productivity,
    "store_pick_rate": pickers.store_pick_rate,
    "picker_bands": pickers.picker_bands,
    "pick_rate_by_store_skill_shift": pickers.pick_rate_by_store_skill_shift,
    "picker_concentration": pickers.picker_concentration,
    "error_vs_experience": pickers.error_vs_experience,
    # products
    "top_skus": products.top_skus,
    "category_by_store": products.category_by_store,
    "category_performance": products.category_performance,
    "category_summary": products.category_summary,
    "category_margin_bands": products.category_margin_bands,
    "velocity_contribution": products.velocity_contribution,
    # substitutions
    "substitution_acceptance": substitutions.substitution_acceptance,
    "sku_stockout": substitutions.sku_stockout,
    "acceptance_by_match": substitutions.acceptance_by_match,
    "acceptance_by_reason": substitutions.acceptance_by_reason,
    "acceptance_by_category": substitutions.acceptance_by_category,
    "substitution_bands": substitutions.substitution_bands,
    "substitution_share": substitutions.substitution_share,
    # exploratory
    "business_kpis": explore.business_kpis,
    "monthly_trend": explore.monthly_trend,
    "store_sla_bands": explore.store_sla_bands,
    "demand_heatmap": explore.demand_heatmap,
    "store_pnl_estimate": explore.store_pnl_estimate,
    "eda_findings": explore.eda_findings,
    # reports / dashboard
    "executive_kpis": reports.executive_kpis,
    "store_status_summary": reports.store_status_summary,
    "scorecard_bands": reports.scorecard_bands,
    "sla_bands": reports.sla_bands,
    "hourly_peak_bands": reports.hourly_peak_bands,
    "key_findings": reports.key_findings,
    "orders_by_city": reports.orders_by_city,
    "order_status_share": reports.order_status_share,
    "revenue_vs_delivery_cost": reports.revenue_vs_delivery_cost,
    # reports as SQL text over the views
    **{name: sql_reports.report(name) for name in sql_reports.REPORTS},
}


def _slice_orders(T):
    """SLA by store on a dashboard slice: city 'Asia', orders dated 1996–1998."""
    return sla.sla_by_store(reports.apply_slicers(T, city="Asia", date_from="1996-01-01", date_to="1998-12-31"))


def _slice_months(T):
    """Delivery percentiles of whole months, from the stored counts of minutes."""
    return sla.delivery_percentiles(reports.apply_slicers(T, date_from="1995-04-01", date_to="1996-09-30"))


def _slice_hours(T):
    """Peak hours of one city's stores, from the stored counts by hour."""
    return reports.hourly_peak_bands(reports.apply_slicers(T, city="Asia"))


def _slice_store(T):
    """SLA of one store."""
    return sla.sla_by_store(reports.apply_slicers(T, store="STR_003"))


def _slice_skill(T):
    """Productivity of the pickers of one skill level."""
    return pickers.picker_productivity(reports.apply_slicers(T, skill="Expert"))


def _slice_shift(T):
    """Productivity of the pickers of one shift."""
    return pickers.picker_productivity(reports.apply_slicers(T, shift="Morning"))


QUERIES: dict[str, QueryFn] = {k: _on_clean(f) for k, f in ANALYTICS.items()}
QUERIES["slice_orders"] = _on_clean(_slice_orders)
QUERIES["slice_months"] = _on_clean(_slice_months)
QUERIES["slice_hours"] = _on_clean(_slice_hours)
QUERIES["slice_store"] = _on_clean(_slice_store)
QUERIES["slice_skill"] = _on_clean(_slice_skill)
QUERIES["slice_shift"] = _on_clean(_slice_shift)


def queries() -> dict[str, QueryFn]:
    out = dict(QUERIES)
    out.update(operator_queries.QUERIES)
    return out
