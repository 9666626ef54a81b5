"""The post-load UPDATE script as pure ``orders -> orders`` column rewrites.

The script's redraw of the measured minutes (M1) is a simulation and is left
out: M2 and M3 work on the measured components.  The draws of M6 and M8 choose
rows; they are seeded hash draws, so results repeat exactly, including on a
recomputed task.  Order matters and is the script's: M2 → M3 → M4 → M5 → M6 →
M7 → M8 (``update_script``); after M8 ``sla_met`` no longer equals total ≤ 10,
and analytics read whichever state they are given.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.functions.exprs import hash_uniform, round_dec
from storepulse.operators.sampling import exact_hash_select

TIME_COLS = ["pick_time_mins", "pack_time_mins", "dispatch_time_mins", "travel_time_mins"]

# fixed values: per-store share of Delivered orders flagged as SLA met
STORE_SLA_RATES = {
    "STR_001": "0.78", "STR_002": "0.82", "STR_003": "0.65", "STR_004": "0.85", "STR_005": "0.72",
    "STR_006": "0.91", "STR_007": "0.61", "STR_008": "0.76", "STR_009": "0.69", "STR_010": "0.88",
}

UNPROFITABLE_SHARE = "0.12"
COST_FACTOR_LOW, COST_FACTOR_WIDTH = 0.85, 0.3


def recompute_total(orders: DataFrame) -> DataFrame:
    """M2: total = sum of the four components."""
    s = F.col(TIME_COLS[0])
    for c in TIME_COLS[1:]:
        s = s + F.col(c)
    return orders.withColumn("total_delivery_mins", round_dec(s, 2, 9))


def recompute_sla(orders: DataFrame, sla_minutes: float = 10.0) -> DataFrame:
    """M3: sla_met = total ≤ threshold."""
    return orders.withColumn("sla_met", F.col("total_delivery_mins") <= sla_minutes)


def recompute_profit(orders: DataFrame) -> DataFrame:
    """M4: gross profit = net value − delivery cost."""
    return orders.withColumn("gross_profit_inr",
                             round_dec(F.col("net_order_value_inr") - F.col("delivery_cost_inr")))


def recompute_profitable(orders: DataFrame) -> DataFrame:
    """M5: is_profitable = gross profit > 0."""
    return orders.withColumn("is_profitable", F.col("gross_profit_inr") > 0)


def sample_exact_fraction(orders: DataFrame, share: str = UNPROFITABLE_SHARE, seed=42, stage=None) -> DataFrame:
    """M6: reprice exactly round(share × n) orders: delivery cost := net × U(0.85, 1.15).

    One draw per order drives cost, profit and flag together, so the row
    stays consistent (cost = net − profit); the reference drew three
    independent randoms here.  Selection is ``exact_hash_select`` (no sort).
    """
    k = lambda total: F.round(total * F.lit(Decimal(share)), 0)  # noqa: E731  exact decimal, half up
    s = exact_hash_select(orders, "order_id", k, seed=seed, tag="reprice", flag="_repriced",
                          stage=stage)
    factor = hash_uniform(seed, F.lit("delivery_cost"), F.col("order_id")) * COST_FACTOR_WIDTH + COST_FACTOR_LOW
    cost = round_dec(F.col("net_order_value_inr").cast("double") * factor)
    gp = round_dec(F.col("net_order_value_inr") - cost)
    sel = F.col("_repriced")
    return s.withColumns({
        "delivery_cost_inr": F.when(sel, cost).otherwise(F.col("delivery_cost_inr")),
        "gross_profit_inr": F.when(sel, gp).otherwise(F.col("gross_profit_inr")),
        "is_profitable": F.when(sel, gp > 0).otherwise(F.col("is_profitable")),
    }).withColumnRenamed("_repriced", "repriced")


def reset_flag(orders: DataFrame, col: str = "sla_met") -> DataFrame:
    """M7: set a boolean column to false everywhere."""
    return orders.withColumn(col, F.lit(False))


def _rate_of(store_col: str, rates: dict[str, str]):
    expr = None
    for sid, r in rates.items():
        cond = F.col(store_col) == sid
        expr = F.when(cond, F.lit(Decimal(r))) if expr is None else expr.when(cond, F.lit(Decimal(r)))
    return expr.otherwise(F.lit(Decimal("0")))


def stratified_flag(orders: DataFrame, rates: dict[str, str] = STORE_SLA_RATES, seed=42, stage=None) -> DataFrame:
    """M7+M8: reset ``sla_met``, then flag floor(total × rate(store)) Delivered
    orders per store in hash order.  Stores without a rate, orders without a
    store and non-delivered orders end false.  Per-store selection via
    ``exact_hash_select``: one pass over the orders."""
    is_delivered = F.coalesce(F.col("order_status") == "Delivered", F.lit(False))
    d = reset_flag(orders).withColumn("_delivered", is_delivered)
    k = lambda total: F.when(F.col("_delivered"), F.floor(total * _rate_of("store_id", rates)))  # noqa: E731  exact decimal product
    flagged = exact_hash_select(d, "order_id", k, seed=seed, tag="sla", strata=["store_id", "_delivered"], flag="_f",
                                stage=stage)
    return flagged.withColumn("sla_met", F.col("_f")).drop("_f", "_delivered")


def update_script(orders: DataFrame, seed=42, stage=None) -> DataFrame:
    """M2..M8 in the script's order.

    ``stage(name, df) -> df`` may persist the few columns that the samples are drawn from."""
    o = recompute_profitable(recompute_profit(recompute_sla(recompute_total(orders))))
    o = sample_exact_fraction(o, seed=seed, stage=stage).drop("repriced")
    return stratified_flag(o, seed=seed, stage=stage)
