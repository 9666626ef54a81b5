"""Product and category analytics over order items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.exprs import exact_mean, exact_round, safe_div
from storepulse.operators.distinct import distinct_counts
from storepulse.operators.ranking import join_null_safe
from storepulse.plans.common import store_dim
from storepulse.plans.summaries import summary

# fixed values: category margin colour thresholds (percent)
MARGIN_GREEN, MARGIN_RED = 25.0, 18.0


SKU_GROUP = ["sku_name", "category", "velocity_class"]


def top_skus(T: dict[str, DataFrame], k: int = 20) -> DataFrame:
    """Top-``k`` SKUs (by name, category and velocity class) by item revenue, with RANK().

    Items are summed per SKU id before the SKU dimension join; ids that share a
    name, category and class are one group, as in the reference.  The top-k is a
    TakeOrderedAndProject (per-partition top-k, then a k-row merge).  Distinct
    orders are counted for the items of the k winners alone.  The rank is
    computed on those k rows only — exact, because every group with a strictly
    larger revenue is itself inside the top k.  Ties at the cut are broken by
    name, category and velocity class.
    """
    skus = T["dim_skus"].select("sku_id", *SKU_GROUP)
    pct = F.col("item_margin_pct").cast("decimal(18,4)")
    per = T["fact_order_items"].groupBy("sku_id").agg(
        F.sum("quantity").alias("_qty"), F.sum("item_total_inr").alias("_rev"), F.sum("item_margin_inr").alias("_margin"),
        F.sum(pct).alias("_pct"), F.count(pct).alias("_n"))
    groups = per.join(skus, "sku_id").groupBy(*SKU_GROUP).agg(*[F.sum(c).alias(c) for c in ("_qty", "_rev", "_margin", "_pct", "_n")])
    best = groups.orderBy(F.col("_rev").desc(), *SKU_GROUP).limit(k)
    winners = join_null_safe(skus, F.broadcast(best.select(*SKU_GROUP)), SKU_GROUP)      # k rows are broadcast
    orders = (T["fact_order_items"].select("sku_id", "order_id").join(winners, "sku_id")
              .groupBy(*SKU_GROUP).agg(F.countDistinct("order_id").alias("orders_containing_sku")))
    top = (join_null_safe(orders, F.broadcast(best), SKU_GROUP)
           .withColumn("total_qty_sold", F.col("_qty").cast("bigint"))
           .withColumn("_pct", safe_div(F.col("_pct").cast("double"), "_n")))
    w = Window.orderBy(F.col("_rev").desc())
    return top.select(
        "sku_name", "category", "velocity_class", "orders_containing_sku", "total_qty_sold",
        exact_round("_rev", 0).alias("total_revenue"),
        exact_round("_margin", 0).alias("total_margin"),
        exact_round("_pct", 3).alias("avg_margin_pct"),
        F.rank().over(w).cast("bigint").alias("revenue_rank"))


def _with_orders(per: DataFrame, orders: DataFrame, by: list[str]) -> DataFrame:
    """``per`` with the count in ``orders``; a group whose rows name no order has none."""
    count = orders.columns[-1]
    return join_null_safe(per, orders, by, "left").withColumn(count, F.coalesce(count, F.lit(0).cast("long")))


def category_by_store(T: dict[str, DataFrame]) -> DataFrame:
    by = ["store_id", "category"]
    per = T["fact_order_items"].groupBy(*by).agg(
        F.sum("quantity").cast("bigint").alias("total_qty"),
        F.sum("item_total_inr").alias("_rev"))
    # a row for each store and category on both sides
    per = _with_orders(per, distinct_counts(summary(T, "order_bitmaps"), by, "orders"), by)
    # share of the store's revenue: a window over the aggregate, one row per
    # category in each store partition (bounded by the category count)
    per = per.withColumn("_store_rev", F.sum("_rev").over(Window.partitionBy("store_id")))
    j = per.join(store_dim(T, "store_name", "city"), "store_id")
    rev = exact_round("_rev", 0)
    return j.select(
        "store_id", "store_name", "city", "category", "orders", "total_qty", rev.alias("revenue"),
        exact_round(rev * 100.0 / F.nullif(F.col("_store_rev").cast("double"), F.lit(0.0)), 2)
        .alias("revenue_share_pct"),
    ).orderBy("store_name", F.col("revenue").desc(), "category")


def category_performance(T: dict[str, DataFrame]) -> DataFrame:
    return T["fact_order_items"].groupBy("category").agg(
        F.sum("quantity").cast("bigint").alias("total_qty"),
        exact_round(F.sum("item_total_inr"), 0).alias("total_revenue"),
        exact_round(F.sum("item_margin_inr"), 0).alias("total_margin"),
        exact_round(exact_mean("item_margin_pct", 4) * 100, 1).alias("avg_margin_pct"),
    ).orderBy(F.col("total_revenue").desc(), "category")


def category_summary(T: dict[str, DataFrame]) -> DataFrame:
    """Revenue, weighted margin %, share of total and relative volume per category."""
    per = T["fact_order_items"].groupBy("category").agg(
        F.sum("item_total_inr").alias("_rev"), F.sum("item_margin_inr").alias("_m"),
        F.sum("quantity").cast("bigint").alias("total_qty"))
    per = _with_orders(per, distinct_counts(summary(T, "order_bitmaps"), ["category"], "order_count"), ["category"])
    # category-sized result: totals over it are a one-row aggregate, broadcast
    tot = per.agg(F.sum("_rev").alias("_tot"), F.max("total_qty").alias("_maxq"))
    j = per.crossJoin(F.broadcast(tot))
    margin_pct = exact_round(safe_div("_m", "_rev") * 100, 1)
    out = j.select(
        "category", exact_round("_rev", 2).alias("total_revenue"), exact_round("_m", 2).alias("total_margin"),
        "total_qty", "order_count", margin_pct.alias("margin_pct"),
        exact_round(F.col("_rev").cast("double") / 100000.0, 1).alias("revenue_lac"),
        exact_round(safe_div("_rev", "_tot") * 100, 1).alias("revenue_share"),
        exact_round(safe_div("total_qty", "_maxq"), 4).alias("volume_rel_max"))
    mean_m = out.agg(exact_round(exact_mean("margin_pct", 1), 2).alias("mean_margin_pct"))
    return out.crossJoin(F.broadcast(mean_m)).orderBy(F.col("total_revenue").desc(), "category")


def category_margin_bands(T: dict[str, DataFrame]) -> DataFrame:
    m = F.col("avg_margin_pct")
    return category_performance(T).withColumn(
        "margin_band", F.when(m >= MARGIN_GREEN, "green").when(m < MARGIN_RED, "red").otherwise("amber"))


def velocity_contribution(T: dict[str, DataFrame]) -> DataFrame:
    """Revenue and margin share per SKU velocity class."""
    per = T["fact_order_items"].groupBy("sku_id").agg(
        F.sum("item_total_inr").alias("_rev"), F.sum("item_margin_inr").alias("_m"))
    v = (per.join(T["dim_skus"].select("sku_id", "velocity_class"), "sku_id")
         .groupBy("velocity_class").agg(F.sum("_rev").alias("_rev"), F.sum("_m").alias("_m")))
    tot = v.agg(F.sum("_rev").alias("_tr"), F.sum("_m").alias("_tm"))
    return v.crossJoin(F.broadcast(tot)).select(
        "velocity_class", exact_round("_rev", 0).alias("revenue"), exact_round("_m", 0).alias("margin"),
        exact_round(safe_div("_rev", "_tr") * 100, 1).alias("revenue_share_pct"),
        exact_round(safe_div("_m", "_tm") * 100, 1).alias("margin_share_pct"))
