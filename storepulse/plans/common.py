"""Helpers shared by the analytics plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELIVERED = "Delivered"


def delivered(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") == DELIVERED)


def store_dim(T: dict[str, DataFrame], *cols: str) -> DataFrame:
    """Store attributes as a broadcast side.

    Stores derive from ``nation`` (25 rows at every TPC-H scale factor), so
    the broadcast has a proven size bound; fact tables are aggregated to the
    store level *before* this join so the join itself touches few rows.
    """
    return F.broadcast(T["dim_stores"].select("store_id", *cols))


def rank_desc(col: str, *tiebreak: str):
    """RANK() over the whole (store-sized) result by ``col`` descending.

    Only used on aggregates bounded by the number of stores; for rankings
    over unbounded dimensions see ``operators.ranking.exact_rank``.
    """
    w = Window.orderBy(F.col(col).desc_nulls_last(), *[F.col(t) for t in tiebreak])
    return F.rank().over(w).cast("bigint")
