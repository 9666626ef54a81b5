"""Stored summaries of the facts, from which reports come without reading these.

* ``minute_counts``: Delivered orders by month, store and delivery minutes.  Minutes have two decimals
  and are capped, so a month of a store has a bounded number of rows, whatever its orders; exact
  percentiles, means and extremes of any stores and whole months come from adding them up.
* ``hour_counts``: Delivered orders by month, store and hour: orders, sum of minutes, orders in time.
* ``store_months``: all orders by month, store and status: counts and exact sums of money and minutes, from
  which store and month reports and the findings come.
* ``order_bitmaps``: the orders of each store and category as mergeable bitmaps (``operators.distinct``).
* ``customer_bitmaps``: the customers of each store, likewise.

``summary(T, name)`` gives one: the stored table where ``T`` is a ``TableSet`` that has it, else
the same table derived from ``T``'s facts.  A slice of a ``TableSet`` by store, city and whole months keeps
the stored summaries that have these columns, filtered.
"""

from __future__ import annotations

import calendar
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.functions.exprs import safe_div
from storepulse.operators.distinct import bucket_count, member_bitmaps
from storepulse.plans.common import delivered
from storepulse.sources.tables import month_of

MINUTES = "total_delivery_mins"
#: What ``store_months`` adds up, by name.
SUMS = {"revenue": "net_order_value_inr", "profit": "gross_profit_inr", "minutes": MINUTES, "pick": "pick_time_mins", "travel": "travel_time_mins"}


def _by_month(orders: DataFrame) -> DataFrame:
    return orders if "order_month" in orders.columns else orders.withColumn("order_month", month_of())


def minute_counts(T: dict[str, DataFrame]) -> DataFrame:
    return _by_month(delivered(T["fact_orders"])).groupBy("order_month", "store_id", MINUTES).agg(F.count("order_id").alias("orders"), F.count(F.lit(1)).alias("rows"))


def hour_counts(T: dict[str, DataFrame]) -> DataFrame:
    return _by_month(delivered(T["fact_orders"])).groupBy("order_month", "store_id", "order_hour").agg(
        F.count("order_id").alias("orders"), F.count(F.lit(1)).alias("rows"), F.sum(MINUTES).alias("minutes"),
        F.count(MINUTES).alias("timed"), F.sum(F.when(F.col("sla_met"), 1).otherwise(0)).cast("bigint").alias("met"))


def store_months(T: dict[str, DataFrame]) -> DataFrame:
    sums = [F.sum(c).alias(name) for name, c in SUMS.items()] + [F.count(c).alias(f"n_{name}") for name, c in SUMS.items()]
    return _by_month(T["fact_orders"]).groupBy("order_month", "store_id", "order_status").agg(
        F.count("order_id").alias("orders"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(F.col("sla_met"), 1).otherwise(0)).cast("bigint").alias("met"), *sums)


def month_date() -> Column:
    """The first day of a summary's month."""
    return F.to_date(F.concat("order_month", F.lit("-01")))


def mean_of(name: str) -> Column:
    """The mean of a summed column of ``store_months``, in an aggregate of it."""
    return safe_div(F.sum(name), F.sum(f"n_{name}"))


def order_bitmaps(T: dict[str, DataFrame]) -> DataFrame:
    items = T["fact_order_items"]
    return member_bitmaps(items, ["store_id", "category"], "order_id", "store_id", bucket_count(items, "order_id", "store_id"))


def customer_bitmaps(T: dict[str, DataFrame]) -> DataFrame:
    orders = T["fact_orders"]
    return member_bitmaps(orders, ["store_id"], "customer_id", None, bucket_count(orders, "customer_id"))


BUILDERS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {
    f.__name__: f for f in (minute_counts, hour_counts, store_months, order_bitmaps, customer_bitmaps)}
#: Summaries that are kept by month, so that whole months can be cut out of them.
MONTHLY = ("minute_counts", "hour_counts", "store_months")


class TableSet(dict):
    """The eight tables and the audit, with the summaries that are stored beside them.

    ``opened(names)`` gives tables that are in ``names`` and not there yet, when they are first read: a query that
    reads one table has no other built but those that its cleaning needs."""

    def __init__(self, tables: dict[str, DataFrame], stored: Callable[[str], DataFrame | None], names: Sequence[str] = (),
                 opened: Callable[[Sequence[str]], dict[str, DataFrame]] | None = None):
        super().__init__(tables)
        self.stored, self.opened = stored, opened
        self.names = [*names, *(n for n in tables if n not in names)]

    def __missing__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        self.update(self.opened([name]))
        return self[name]

    def whole(self) -> TableSet:
        """All tables, those that are missing opened together."""
        missing = [n for n in self.names if not dict.__contains__(self, n)]
        if missing:
            self.update(self.opened(missing))
        return self

    def __contains__(self, name) -> bool:
        return name in self.names

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def get(self, name, default=None):
        return self[name] if name in self else default

    def keys(self):
        return dict.fromkeys(self.names).keys()

    def items(self):
        return {n: self.whole()[n] for n in self.names}.items()

    def values(self):
        return dict(self.items()).values()


def summary(T: dict[str, DataFrame], name: str) -> DataFrame:
    found = T.stored(name) if isinstance(T, TableSet) else None
    return BUILDERS[name](T) if found is None else found


def whole_months(date_from: str | None, date_to: str | None) -> bool:
    """Whether a range of dates (ISO, inclusive) begins and ends with a month."""
    last = date.fromisoformat(date_to) if date_to else None
    return (date_from is None or date.fromisoformat(date_from).day == 1) and \
        (last is None or last.day == calendar.monthrange(last.year, last.month)[1])


def sliced(T: dict[str, DataFrame], tables: dict[str, DataFrame], stores: DataFrame | None,
           date_from: str | None, date_to: str | None) -> dict[str, DataFrame]:
    """``tables`` (a slice of ``T``) with ``T``'s stored summaries cut alike, where whole months are asked for."""
    if not isinstance(T, TableSet):
        return tables

    def stored(name: str) -> DataFrame | None:
        dated = date_from is not None or date_to is not None
        if dated and (name not in MONTHLY or not whole_months(date_from, date_to)):
            return None
        df = T.stored(name)
        if df is None:
            return None
        if date_from is not None:
            df = df.where(F.col("order_month") >= date_from[:7])
        if date_to is not None:
            df = df.where(F.col("order_month") <= date_to[:7])
        return df if stores is None else df.join(stores, "store_id", "left_semi")

    return TableSet(tables, stored)
