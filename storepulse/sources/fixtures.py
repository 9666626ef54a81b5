"""Raw star-schema tables derived from the driver's TPC-H-style Parquet.

The reference ships no fact inputs, so the eight raw tables are derived
deterministically from ``region nation customer supplier part orders
lineitem`` with the rules documented in FIXTURES.md §2, including injected
anomalies that exercise every cleaning rule.  Everything is a lazy
DataFrame: the work grows with the input tables.

Scale notes
-----------
* ``dim_stores`` comes from ``nation`` (25 rows in TPC-H at every scale
  factor), so it is the only dimension we hint as broadcast.
* SKUs (``part``), customers and pickers (``supplier``) grow with the scale
  factor; their joins are left to the planner up to ``BROADCAST_ROWS`` rows
  and merged beyond (``bounded``), as the planner goes by the size of their
  compressed files.
* Money and minutes are rounded through ``round_dec`` (decimal(28,10) first)
  so fixtures are bit-identical across engines.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.functions.exprs import fmt_id, round_dec, exact_round
from storepulse.sources.tables import month_of

TPCH_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


#: Rows of a table up to which the planner may broadcast it.
BROADCAST_ROWS = 500_000


def bounded(side: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``side`` of a join, which is merged where it (or ``of``, with as many rows at least) has more than ``BROADCAST_ROWS`` rows.

    The planner estimates by compressed files: a column or two of millions of rows would be broadcast through the driver.
    The rows of a Parquet table are counted by its footers."""
    return side if (side if of is None else of).count() <= BROADCAST_ROWS else side.hint("merge")


def read_tpch(spark: SparkSession, sf_dir: str, names=TPCH_TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


@dataclass
class Lines:
    """A raw fact table before its columns are worked out.

    ``rows``: the joined rows with the narrow columns that ``columns`` are expressions of, ``date`` (of the
    order date), ``store`` (which stores are sorted by) and the key that cleaning checks.  Shuffles of ``rows`` are much smaller than of ``df``."""
    rows: DataFrame
    columns: list[Column | str]
    date: str
    store: str

    @property
    def df(self) -> DataFrame:
        return self.rows.select(*self.columns)

    def dealt(self, rows: DataFrame, *added: str) -> DataFrame:
        """The table of ``rows``, which may have ``added`` columns, dealt out by month while they are narrow."""
        rows = rows.withColumn("order_month", month_of(self.date)).hint("rebalance", "order_month")
        return rows.sortWithinPartitions("order_month", self.store).select(*self.columns, *added, "order_month")


def _money(c):
    return round_dec(c, 2, 18)


def _mins(c):
    return round_dec(c, 2, 9)


# fixed values: payment methods by key % 4, shift by key % 3, sub reasons by line number
PAYMENT_METHODS = ["UPI", "Card", "Wallet", "COD"]
ROSTER_SHIFTS = ["Morning", "Afternoon", "Night"]


def _pick(key, values):
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, v) if expr is None else expr.when(key == i, v)
    return expr


def raw_stores(t: dict[str, DataFrame]) -> DataFrame:
    n = F.col("n_nationkey")
    nr = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return nr.select(
        fmt_id("STR_", n + 1, 3).alias("store_id"),
        F.col("n_name").alias("store_name"),
        F.concat(F.lit(" "), F.lower("r_name")).alias("city"),
        F.col("r_name").alias("zone"),
        (F.lit(8) + (n * 3) % 31).cast("double").alias("latitude"),
        (F.lit(70) + n + F.when(n == 13, 20).otherwise(0)).cast("double").alias("longitude"),
        (F.lit(2500) + n * 40).cast("int").alias("store_area_sqft"),
        (F.lit(8) + n % 5).cast("int").alias("max_picker_capacity"),
        F.date_add(F.lit("1994-01-01").cast("date"), (n * 30).cast("int")).alias("launch_date"),
        F.when(n == 24, 0).when(n % 8 == 7, 9000000).otherwise(F.lit(800000) + n * 10000)
        .cast("bigint").alias("monthly_fixed_cost_inr"),
        (F.lit(2.0) + (n % 3).cast("double") * 0.5).alias("catchment_radius_km"),
        F.lit(True).alias("is_active"),
    )


def D(v: str):
    """Exact decimal literal: money math stays in decimal, so rounding ties
    resolve the same way on every engine (no double → decimal conversion)."""
    return F.lit(Decimal(v))


def _dec(c, scale: int = 0):
    return c.cast(f"decimal(18,{scale})")


def _sku_prices(part: DataFrame) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    price = F.when(k % 83 == 5, D("0.00")).otherwise(_dec(F.col("p_retailprice"), 2))
    cost = F.when(k % 50 == 1, price * D("1.1")).otherwise(price * _dec(size % 20 + 68) * D("0.01"))
    mrp = F.when(k % 61 == 2, price * D("0.9")).otherwise(price * D("1.15"))
    return part.select(
        "*",
        _money(price).alias("unit_price_inr"),
        _money(cost).alias("cost_price_inr"),
        _money(mrp).alias("mrp_inr"),
    )


def raw_skus(t: dict[str, DataFrame]) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    p = _sku_prices(t["part"])
    price_d, cost_d = F.col("unit_price_inr").cast("double"), F.col("cost_price_inr").cast("double")
    return p.select(
        fmt_id("SKU_", k, 6).alias("sku_id"),
        F.concat_ws(" ", F.col("p_name"), k.cast("string")).alias("sku_name"),
        F.concat(F.lit(" "), F.col("p_type")).alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.col("p_brand").alias("brand"),
        "unit_price_inr", "mrp_inr", "cost_price_inr",
        exact_round((price_d - cost_d) / F.nullif(price_d, F.lit(0.0)), 4).alias("gross_margin_pct"),
        (size.cast("double") / 10.0).alias("weight_kg"),
        (size - 1).cast("int").alias("shelf_life_days"),
        (size % 7 == 0).alias("requires_refrigeration"),
        _pick(k % 3, ["a ", "b ", "c "]).alias("velocity_class"),
        F.lit(True).alias("is_active"),
    )


def raw_customers(t: dict[str, DataFrame]) -> DataFrame:
    ck = F.col("c_custkey")
    geo = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")) \
        .select("n_nationkey", "r_name")
    c = t["customer"].join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    email_id = F.when(ck % 40 == 39, ck - 1).otherwise(ck)
    return c.select(
        fmt_id("CUST_", ck, 6).alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.format_string("9%09d", ck).alias("phone"),
        F.upper(F.concat(F.lit(" user"), email_id.cast("string"), F.lit("@example.com "))).alias("email"),
        F.col("r_name").alias("city"),
        F.format_string("%06d", F.col("c_nationkey") + 110000).alias("pin_code"),
        F.date_add(F.lit("1996-01-01").cast("date"), (ck % 2500).cast("int")).alias("signup_date"),
        F.col("c_mktsegment").alias("customer_segment"),
        _pick(ck % 4, PAYMENT_METHODS).alias("preferred_payment"),
        _money(F.col("c_acctbal")).alias("avg_basket_size_inr"),
        (ck % 180 - 2).cast("int").alias("lifetime_orders"),
        F.lit(True).alias("is_active"),
    )


def raw_pickers(t: dict[str, DataFrame]) -> DataFrame:
    sk = F.col("s_suppkey")
    bal = F.col("s_acctbal")
    return t["supplier"].select(
        fmt_id("PKR_", sk, 4).alias("picker_id"),
        F.col("s_name").alias("picker_name"),
        fmt_id("STR_", F.col("s_nationkey") + 1, 3).alias("store_id"),
        _pick(sk % 3, ROSTER_SHIFTS).alias("shift"),
        F.date_add(F.lit("1998-01-01").cast("date"), ((sk * 37) % 1500).cast("int")).alias("join_date"),
        (sk % 48).cast("int").alias("experience_months"),
        F.when(bal > 6500, "Expert").when(bal > 2500, "Intermediate").otherwise("Beginner")
        .alias("skill_level"),
        F.when(sk % 17 == 0, 50000).otherwise(F.lit(14000) + (sk * 100) % 10000)
        .cast("bigint").alias("monthly_salary_inr"),
        F.lit(True).alias("is_active"),
    )


def order_keys(t: dict[str, DataFrame]) -> DataFrame:
    """orders ⋈ customer: every order with its customer's nation (the store)."""
    cust = t["customer"].select("c_custkey", "c_nationkey")
    return t["orders"].join(bounded(cust), F.col("o_custkey") == F.col("c_custkey")) \
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "c_nationkey")


def _order_keys(t: dict[str, DataFrame]) -> DataFrame:
    """The enriched orders; a staged copy (``t["order_keys"]``) is used when
    present so raw orders and raw items share ONE orders ⋈ customer join."""
    return t["order_keys"] if "order_keys" in t else order_keys(t)


def order_lines(t: dict[str, DataFrame]) -> Lines:
    """Orders with the columns of ``order_keys`` as their narrow rows."""
    k, tp = F.col("o_orderkey"), _dec(F.col("o_totalprice"), 2)
    ok = F.col("o_custkey")
    hour = ((k * 7) % 24).cast("int")
    odate = F.col("o_orderdate").cast("date")
    disc_raw = tp * _dec(k % 5) * D("0.05")
    value = _money(F.when(k % 401 == 3, D("0.00")).otherwise(tp))
    status = F.when(F.col("o_orderstatus").isin("F", "P"), "Delivered") \
        .when(k % 9 < 7, "Cancelled").otherwise("RTO")
    pick = _mins(F.when(k % 97 == 0, D("-1.0")).otherwise(_dec(k % 37) * D("0.1") + D("2")))
    pack = _mins(_dec(k % 11) * D("0.1") + D("1"))
    disp = _mins(_dec(k % 13) * D("0.1") + D("0.5"))
    travel = _mins(F.when(k % 211 == 0, D("150.0")).when(k % 307 == 0, D("30.0"))
                   .when(k % 149 == 0, D("14.0")).otherwise(_dec(k % 41) * D("0.1") + D("1")))
    total = (pick + pack + disp + travel + F.when(k % 50 == 0, 1).otherwise(0)).cast("decimal(9,2)")
    keys = _order_keys(t)
    # every 500th order arrives twice (duplicate-key anomaly)
    return Lines(keys.unionByName(keys.filter(k % 500 == 0)), [
        fmt_id("ORD_", k, 8).alias("order_id"),
        fmt_id("STR_", F.col("c_nationkey") + 1, 3).alias("store_id"),
        fmt_id("CUST_", F.when(ok % 40 < 4, ok - ok % 40).otherwise(ok), 6).alias("customer_id"),
        F.timestamp_add("HOUR", hour, F.col("o_orderdate")).alias("order_timestamp"),
        odate.alias("order_date"),
        hour.alias("order_hour"),
        F.date_format(odate, "EEEE").alias("day_of_week"),
        F.month(odate).alias("month"),
        F.quarter(odate).alias("quarter"),
        (F.weekday(odate) >= 5).alias("is_weekend"),
        _pick(k % 4, PAYMENT_METHODS).alias("payment_method"),
        value.alias("order_value_inr"),
        _money(F.when(k % 89 == 0, tp).otherwise(disc_raw)).alias("discount_amount_inr"),
        F.when(value >= 149, 0).otherwise(25).cast("decimal(18,2)").alias("delivery_charge_inr"),
        _money(tp * D("0.03")).alias("platform_fee_inr"),
        _money(tp * D("1.03") - disc_raw).alias("net_order_value_inr"),
        pick.alias("pick_time_mins"),
        pack.alias("pack_time_mins"),
        disp.alias("dispatch_time_mins"),
        travel.alias("travel_time_mins"),
        total.alias("total_delivery_mins"),
        (total <= 10).alias("sla_met"),
        _mins(_dec(k % 27) * D("0.1") + D("0.3")).alias("distance_km"),
        _money(F.when(k % 8 == 0, tp * _dec(k % 31 + 85) * D("0.01"))
               .otherwise(_dec(k % 27) * D("0.8") + D("15"))).alias("delivery_cost_inr"),
        status.alias("order_status"),
        (k % 11 + 1).cast("int").alias("num_items"),
        (k % 8 == 1).alias("had_substitution"),
        F.when(status == "Delivered", k % 5 + 1).cast("int").alias("customer_rating"),
    ], "o_orderdate", "c_nationkey")


def raw_orders(t: dict[str, DataFrame]) -> DataFrame:
    from storepulse.sources.schemas import ORDERS
    return order_lines(t).df.select(*ORDERS.fieldNames())


def _id_of(prefix: str, key: str, width: int):
    """``fmt_id`` of a key, null for a null key, which then joins with nothing."""
    return F.when(F.col(key).isNotNull(), fmt_id(prefix, F.col(key), width))


def _line_id(prefix: str):
    return F.concat_ws("_", F.lit(prefix), F.col("l_orderkey").cast("string"),
                      F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                      F.col("l_suppkey").cast("string"))


def order_item_lines(t: dict[str, DataFrame]) -> Lines:
    """Orders are joined by ``order_id``, so that cleaning's check of this key needs no shuffle of its own."""
    li = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                              "l_quantity", "l_returnflag")
    parts = _sku_prices(t["part"]).select("p_partkey", "p_type", "unit_price_inr", "cost_price_inr")
    ords = _order_keys(t).select(
        _id_of("ORD_", "o_orderkey", 8).alias("_order_id"), F.col("c_nationkey").alias("_nation"),
        F.col("o_orderdate").cast("date").alias("order_date"))
    j = li.join(bounded(parts), F.col("l_partkey") == F.col("p_partkey")) \
        .withColumn("order_id", _id_of("ORD_", "l_orderkey", 8)) \
        .join(ords.hint("merge"), F.col("order_id") == F.col("_order_id"))
    rows = j.select("order_id", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag",
                    "p_type", "unit_price_inr", "cost_price_inr", "_nation", "order_date")
    qty = F.when(F.col("l_orderkey") % 173 == 0, 0).otherwise(F.col("l_quantity")).cast("int")
    price, cost = F.col("unit_price_inr"), F.col("cost_price_inr")
    return Lines(rows, [
        _line_id("ITM").alias("item_id"),
        fmt_id("ORD_", F.col("l_orderkey"), 8).alias("order_id"),
        fmt_id("STR_", F.col("_nation") + 1, 3).alias("store_id"),
        fmt_id("SKU_", F.col("l_partkey"), 6).alias("sku_id"),
        F.col("p_type").alias("category"),
        qty.alias("quantity"),
        price.alias("unit_price_inr"),
        cost.alias("unit_cost_inr"),
        (price * qty).cast("decimal(18,2)").alias("item_total_inr"),
        ((price - cost) * qty).cast("decimal(18,2)").alias("item_margin_inr"),
        (F.col("l_returnflag") == "R").alias("is_substituted"),
        "order_date",
    ], "order_date", "_nation")


def raw_order_items(t: dict[str, DataFrame]) -> DataFrame:
    return order_item_lines(t).df


# fixed values: skill efficiency multipliers for pick rate
SKILL_EFFICIENCY = {"Expert": 1.25, "Intermediate": 1.00, "Beginner": 0.78}


def rate_4dp(items_x100, minutes_x100, eff):
    """round(items / minutes × eff, 4) half-up, in integer arithmetic.

    With integer inputs scaled by 100 and eff×10000 an integer, the rounded
    rate×10000 is (2·N + d) div (2·d) for N = items·eff·10000·100 and
    d = minutes·100 — exact, so ties round the same on every engine.  Null
    when minutes is 0.
    """
    e = (eff * 10000).cast("bigint")
    n = items_x100 * e
    d = F.nullif(minutes_x100, F.lit(0).cast("bigint"))
    return (F.floor((n * 2 + d) / (d * 2)).cast("double") / 10000.0)


def shift_from_hour(hour):
    return F.when(hour < 12, "Morning").when(hour < 18, "Afternoon").otherwise("Night")


def picker_activity_lines(t: dict[str, DataFrame]) -> Lines:
    """Suppliers are joined by ``picker_id``, so that cleaning's check of this key needs no shuffle of its own."""
    li = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                              "l_quantity", "l_shipdate")
    bal = F.col("s_acctbal")
    sup = t["supplier"].select(
        _id_of("PKR_", "s_suppkey", 4).alias("_picker_id"), F.col("s_nationkey").alias("_nation"),
        F.when(bal > 6500, "Expert").when(bal > 2500, "Intermediate").otherwise("Beginner")
        .alias("skill_level"))
    j = li.withColumn("picker_id", _id_of("PKR_", "l_suppkey", 4)).join(bounded(sup), F.col("picker_id") == F.col("_picker_id"))
    rows = j.select("picker_id", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate", "_nation", "skill_level")
    k = F.col("l_orderkey")
    hour = ((k * 7) % 24).cast("int")
    dur = (k % 60).cast("int")
    start = F.timestamp_add("HOUR", hour, F.col("l_shipdate"))
    eff = F.when(F.col("skill_level") == "Expert", SKILL_EFFICIENCY["Expert"]) \
        .when(F.col("skill_level") == "Intermediate", SKILL_EFFICIENCY["Intermediate"]) \
        .otherwise(SKILL_EFFICIENCY["Beginner"])
    rate = rate_4dp(F.col("l_quantity").cast("bigint") * 100, dur.cast("bigint") * 100, eff)
    return Lines(rows, [
        _line_id("ACT").alias("activity_id"),
        fmt_id("ORD_", k, 8).alias("order_id"),
        fmt_id("PKR_", F.col("l_suppkey"), 4).alias("picker_id"),
        fmt_id("STR_", F.col("_nation") + 1, 3).alias("store_id"),
        start.alias("pick_start_time"),
        F.timestamp_add("MINUTE", dur, start).alias("pick_end_time"),
        dur.cast("decimal(9,2)").alias("pick_duration_mins"),
        F.col("l_quantity").cast("int").alias("items_picked"),
        rate.alias("pick_rate_per_min"),
        F.when(k % 20 == 0, 2).when((k % 20 == 1) | (k % 20 == 2), 1).otherwise(0)
        .cast("int").alias("errors_made"),
        F.col("l_shipdate").cast("date").alias("order_date"),
        shift_from_hour(hour).alias("shift"),
    ], "l_shipdate", "_nation")


def raw_picker_activity(t: dict[str, DataFrame]) -> DataFrame:
    return picker_activity_lines(t).df


# fixed values: substitution reason by line number (<=5, 6, else)
SUB_REASONS = ["Out of Stock", "Damaged", "Expired"]


def substitution_lines(t: dict[str, DataFrame]) -> Lines:
    li = t["lineitem"].filter(F.col("l_returnflag") == "R") \
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    big = t["part"].count() > BROADCAST_ROWS
    n_parts = t["part"].agg(F.count(F.lit(1)).alias("_n_parts"))   # one row
    p = _sku_prices(t["part"]).select("p_partkey", "p_type", "unit_price_inr")
    p1 = p.select(F.col("p_partkey").alias("_p1"), F.col("p_type").alias("original_category"),
                  F.col("unit_price_inr").alias("_price1"))
    p2 = p.select(F.col("p_partkey").alias("_p2"), F.col("p_type").alias("substitute_category"),
                  F.col("unit_price_inr").alias("_price2"))
    sup = t["supplier"].select(F.col("s_suppkey"), F.col("s_nationkey"))
    # the narrowest first: each join adds columns that the next one shuffles
    j = (li.crossJoin(F.broadcast(n_parts))
         .withColumn("_sub_key", (F.col("l_partkey") + F.col("l_suppkey")) % F.col("_n_parts"))
         .join(bounded(sup), F.col("l_suppkey") == F.col("s_suppkey"))
         .join(p1.hint("merge") if big else p1, F.col("l_partkey") == F.col("_p1"))
         .join(p2.hint("merge") if big else p2, F.col("_sub_key") == F.col("_p2")))
    rows = j.select(fmt_id("ORD_", F.col("l_orderkey"), 8).alias("order_id"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "_sub_key", "s_nationkey", "original_category", "substitute_category", "_price1", "_price2", "l_shipdate")
    same = F.col("original_category") == F.col("substitute_category")
    k = F.col("l_orderkey")
    ln = F.col("l_linenumber")
    return Lines(rows, [
        _line_id("SUB").alias("substitution_id"),
        fmt_id("ORD_", k, 8).alias("order_id"),
        fmt_id("STR_", F.col("s_nationkey") + 1, 3).alias("store_id"),
        fmt_id("SKU_", F.col("l_partkey"), 6).alias("original_sku_id"),
        fmt_id("SKU_", F.col("_sub_key"), 6).alias("substitute_sku_id"),
        "original_category", "substitute_category",
        same.alias("same_category"),
        (F.col("_price2") - F.col("_price1")).cast("decimal(18,2)").alias("price_difference_inr"),
        (k % 100 < F.when(same, 74).otherwise(41)).alias("customer_accepted"),
        F.when(ln <= 5, SUB_REASONS[0]).when(ln == 6, SUB_REASONS[1]).otherwise(SUB_REASONS[2])
        .alias("reason_for_sub"),
        F.col("l_shipdate").cast("date").alias("order_date"),
    ], "l_shipdate", "s_nationkey")


def raw_substitutions(t: dict[str, DataFrame]) -> DataFrame:
    return substitution_lines(t).df


def raw_tables(spark: SparkSession, sf_dir: str, stage=None, lines: bool = False, names: Sequence[str] | None = None) -> dict[str, DataFrame | Lines]:
    """All eight raw tables, or those of ``names``, as lazy DataFrames over ``sf_dir``; with ``lines``, the facts as ``Lines``.

    Only the rows of dimensions are counted at once (``bounded``).
    ``stage(name, df) -> df`` (optional) persists shared intermediates — the
    orders ⋈ customer join feeds both orders and items.
    """
    t = read_tpch(spark, sf_dir)
    makers = {"dim_stores": raw_stores, "dim_skus": raw_skus, "dim_customers": raw_customers, "dim_pickers": raw_pickers,
              "fact_orders": order_lines if lines else raw_orders, "fact_order_items": order_item_lines if lines else raw_order_items,
              "fact_picker_activity": picker_activity_lines if lines else raw_picker_activity,
              "fact_substitutions": substitution_lines if lines else raw_substitutions}
    wanted = [n for n in makers if names is None or n in names]
    if stage is not None and {"fact_orders", "fact_order_items"} & {*wanted}:
        t["order_keys"] = stage("order_keys", order_keys(t))
    return {n: makers[n](t) for n in wanted}
