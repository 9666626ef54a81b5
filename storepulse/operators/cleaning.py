"""Validate → repair/remove → derive → audit, for each of the eight tables.

Each ``clean_<table>`` returns ``(clean_df, audit_df)``; both are lazy, but for the
percentiles below.

How a table is cleaned
----------------------
Rules run in order and every audit count is over the rows that survived the
earlier rules.  Instead of one full pass per rule, the runner keeps an
``_alive`` flag and one boolean flag column per rule in a single projection;
the cleaned table is ``filter(_alive)`` and the audit is ONE aggregation of
the flag columns.  "Any row inconsistent" is an aggregate over the alive rows at that
point, medians and the p99 are exact percentiles by radix selection over them: a few
passes over their columns, run when the rule is reached, whose results are literals of the plan.

Key checks (store/picker/order must exist) are left joins against the
distinct keys of the already-cleaned parent; keep-first de-duplication is a
``groupBy(key).agg(min(struct(order, ...)))`` so even a key that holds a
third of all rows is reduced by map-side partial aggregation instead of
being sorted in one task.

Null semantics (documented deviation): a null never satisfies a "keep"
predicate, so a row with a null in a checked column is always removed, even
when no other row breaks the rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from storepulse.operators.selection import column_percentiles
from storepulse.sources.fixtures import Lines, bounded
from storepulse.sources.tables import by_month, is_monthly
from storepulse.functions.exprs import (
    band_left_closed, band_right_closed, exact_round, round_dec, safe_div, title_case,
)

def DEC(v: str) -> Column:
    """Exact decimal literal (a Python float would turn decimal math into double)."""
    return F.lit(Decimal(v))


# fixed values: default "today" per table, as parameters instead of the wall clock
AS_OF = {"stores": "2001-12-31", "customers": "1999-12-31", "pickers": "2001-12-31"}

# fixed values: band edges and labels
HOUR_BAND_EDGES = [0, 6, 12, 17, 21, 24]
HOUR_BAND_LABELS = ["Late Night", "Morning", "Afternoon", "Evening", "Night"]
SPEED_BAND_EDGES = [0, 8, 10, 15, 25, 120]
SPEED_BAND_LABELS = ["<8 mins", "8-10 mins", "10-15 mins", "15-25 mins", ">25 mins"]
PRODUCTIVITY_EDGES = [0, 0.8, 1.2, 1.8, 20]
PRODUCTIVITY_LABELS = ["Low", "Medium", "High", "Elite"]


@dataclass
class Rule:
    """One cleaning step.

    kind:
      ``remove``  keep rows where ``pred`` is true (null → removed); count = removed
      ``repair``  count rows where ``pred`` is true; apply ``updates``
      ``audit``   count rows where ``pred`` is true; change nothing
      ``derive``  apply ``updates``; count = all alive rows (always written)
      ``dedup``   keep the first row per ``key`` ordered by ``order``; count = dropped
    ``stats_fn``: statistics of the alive rows at this point, made available as
    columns to ``pred``/``updates`` (literals).
    """
    kind: str
    issue: str
    action: str
    pred: Column | None = None
    updates: dict[str, Column] = field(default_factory=dict)
    key: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    always: bool = False
    audited: bool = True
    stats_fn: object = None   # alive rows -> {column name: value}, worked out by jobs of its own


def _keep_first(df: DataFrame, key: list[str], order: list[str], persist=None, derived: dict[str, Column] | None = None) -> DataFrame:
    """First row per key by ``order`` (then every other column); adds ``_dups``.

    One ``min(struct)`` per key: a single shuffle, before which each task keeps one row of
    a key, so a key with very many rows is small by then.  Null keys group together, as
    in a group-by.

    ``persist(name, df) -> df`` stores the keys that repeat, found by counting keys alone; then
    only rows of these keys are packed, sorted and shuffled whole.  Their join is left to the
    planner up to a number of keys.  Columns of ``derived`` are worked out for these rows only, to order them.
    """
    cols = [c for c in df.columns if c not in key]
    if persist is not None:
        repeated = persist("repeated_" + "_".join(key), df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
                           .select(*[F.col(c).alias(f"_key_{c}") for c in key]))
        repeated = bounded(repeated)
        same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in key]
        alone = df.join(repeated, same, "left_anti").select(*key, *cols, F.lit(0).cast("bigint").alias("_dups"))
        rows = df.join(repeated, same, "left_semi")
        first = _keep_first(rows.withColumns(derived) if derived else rows, key, order)
        return alone.unionByName(first.select(*alone.columns))
    packed = F.struct(*order, *[c for c in cols if c not in order])
    return (df.groupBy(*key).agg(F.min(packed).alias("_r"), (F.count(F.lit(1)) - 1).alias("_dups"))
            .select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols], "_dups"))


class CountedOnce:
    """Audit counts of rows that a shuffle follows, by an aggregate of their own: a map task
    that runs again would add to observed counts twice."""

    def __init__(self, counts: DataFrame):
        self._counts = counts

    @property
    def get(self) -> dict:
        return self._counts.first().asDict()


class ObservedAudit:
    """Audit counts collected by ``DataFrame.observe`` while the cleaned table
    is written (no second pass).  ``to_df`` is valid after that action."""

    def __init__(self, table: str, rules: list[Rule], parts: list[tuple[Observation | CountedOnce, list[int]]]):
        self.table, self.rules, self.parts = table, rules, parts

    def rows(self) -> list[tuple]:
        out = []
        for obs, idx in self.parts:
            got = obs.get
            for i in idx:
                r = self.rules[i]
                n = int(got.get(f"_n{i}") or 0)
                if n > 0 or r.always or r.kind == "derive":
                    out.append((self.table, r.issue, r.action, n))
        return out


def _ruled(df: DataFrame, r: Rule, flag: str) -> DataFrame:
    """``df`` with the flag of a rule, and with its updates."""
    if r.kind == "remove":
        keep = F.coalesce(r.pred, F.lit(False))
        df = df.withColumn(flag, F.col("_alive") & ~keep).withColumn("_alive", F.col("_alive") & keep)
    elif r.kind == "derive":
        df = df.withColumn(flag, F.col("_alive"))
    else:
        df = df.withColumn(flag, F.col("_alive") & F.coalesce(r.pred, F.lit(False)))
    return df.withColumns(r.updates) if r.updates else df


def run_rules(df: DataFrame, table: str, rules: list[Rule], observe: bool = False,
              persist=None, lines: Lines | None = None) -> tuple[DataFrame, DataFrame | ObservedAudit]:
    """Apply ``rules`` in order; return (clean_df, audit).

    ``observe=False``: audit is a lazy DataFrame (one aggregate per segment).
    ``observe=True``: audit counts ride along the write of ``clean_df``
    (``DataFrame.observe``) and come back as an ``ObservedAudit``.
    ``persist(name, df) -> df``: materializes the de-duplicated frame so the
    statistics passes after it read the stored rows instead of repeating the
    de-duplication shuffle (their pruned column sets defeat exchange reuse).
    ``lines`` (with ``observe`` and ``persist``): the columns of ``lines.rows`` are in ``df`` beside those worked
    out from them.  Only the former are kept by the de-duplication, stored and dealt out by month; statistics
    read the stored rows.
    """
    narrow = lines.rows.columns if lines is not None else []
    out_cols = [c for c in df.columns if c not in narrow]
    dealt = None
    observed: list[tuple[Observation | CountedOnce, list[int]]] = []
    df = df.withColumn("_alive", F.lit(True))
    segments: list[tuple[DataFrame, list[tuple[int, str]]]] = []
    flags: list[tuple[int, str]] = []
    for i, r in enumerate(rules):
        if r.stats_fn is not None:
            found = {n: F.lit(v).cast("double") for n, v in r.stats_fn(df.filter(F.col("_alive"))).items()}
            df, dealt = df.withColumns(found), dealt and dealt.withColumns(found)
        fc = f"_f{i}"
        if r.kind in ("remove", "repair", "audit", "derive"):
            df, dealt = _ruled(df, r, fc), dealt and _ruled(dealt, r, fc)
        elif r.kind == "dedup":
            if observe:
                if flags:
                    counts = df.agg(*[_count_expr(rules[i], i, fc) for i, fc in flags])
                    observed.append((CountedOnce(counts), [i for i, _ in flags]))
            else:
                segments.append((df, flags))
            flags = []
            base = df.filter(F.col("_alive"))
            if lines is None:
                kept = _keep_first(base.select(*out_cols), r.key, r.order, persist)
            else:
                derived = dict(zip(lines.df.columns, lines.columns))
                added = [c for c in out_cols if c not in derived]
                kept = _keep_first(base.select(*r.key, *narrow, *added), r.key, r.order, persist,
                                   {c: v for c, v in derived.items() if c not in r.key})
                added.append("_dups")
                kept = kept.select(*narrow, *added)
            if persist is not None:
                kept = persist(f"{table}__dedup", kept)
            if lines is not None:
                dealt = lines.dealt(kept, *added).withColumn("_alive", F.lit(True)).withColumnRenamed("_dups", fc)
                kept = kept.select(*lines.columns, *added)
            df = kept.withColumn("_alive", F.lit(True))
            df = df.withColumn(fc, F.col("_dups")).drop("_dups")
            flags.append((i, fc))
            continue
        else:
            raise ValueError(r.kind)
        if r.updates:
            out_cols += [c for c in r.updates if c not in out_cols]
        if r.audited:
            flags.append((i, fc))
    if observe:
        df = df if dealt is None else dealt
        if is_monthly(table, df):
            df = by_month(df)     # before the counts, so that they are taken by the writing tasks
            out_cols += [c for c in ["order_month"] if c not in out_cols]
        if flags:
            df, o = _observe(df, rules, flags)
            observed.append((o, [i for i, _ in flags]))
        clean = df.filter(F.col("_alive")).select(*out_cols)
        return clean, ObservedAudit(table, rules, observed)
    segments.append((df, flags))

    clean = df.filter(F.col("_alive")).select(*out_cols)   # drops stats and flag columns

    audits = []
    for seg_df, seg_flags in segments:
        if not seg_flags:
            continue
        counts = seg_df.agg(*[
            (F.sum(F.col(fc)) if rules[i].kind == "dedup" else
             F.sum(F.col(fc).cast("int"))).cast("bigint").alias(f"_n{i}")
            for i, fc in seg_flags])
        rows = F.array(*[F.struct(
            F.lit(table).alias("table"),
            F.lit(rules[i].issue).alias("issue_found"),
            F.lit(rules[i].action).alias("action_taken"),
            F.coalesce(F.col(f"_n{i}"), F.lit(0).cast("bigint")).alias("rows_affected"),
            F.lit(rules[i].always or rules[i].kind == "derive").alias("_always"))
            for i, _ in seg_flags])
        audits.append(counts.select(F.inline(rows)))
    audit = audits[0]
    for a in audits[1:]:
        audit = audit.unionByName(a)
    audit = audit.filter((F.col("rows_affected") > 0) | F.col("_always")).drop("_always")
    return clean, audit


def _count_expr(rule: Rule, i: int, fc: str) -> Column:
    c = F.sum(F.col(fc)) if rule.kind == "dedup" else F.sum(F.col(fc).cast("int"))
    return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")).alias(f"_n{i}")


def _observe(df: DataFrame, rules: list[Rule], flags: list[tuple[int, str]]):
    o = Observation()
    return df.observe(o, *[_count_expr(rules[i], i, fc) for i, fc in flags]), o


def _fk_flag(df: DataFrame, parent: DataFrame, key: str, flag: str, broadcast: bool = False,
             unique: bool = False, stored: bool = False) -> DataFrame:
    """Left join a marker telling whether ``key`` exists in ``parent``.

    Keys are de-duplicated first so the join never multiplies rows, except
    when ``unique`` says the parent is unique on ``key`` by construction (the
    cleaned orders, after the keep-first rule) — that skips a full shuffle of
    the parent's keys.  Such a parent grows with the facts: it is merged, never
    broadcast, as its files' size says little of its keys' size in memory.
    ``broadcast`` only for parents with a proven size bound (stores).  A ``stored`` parent is merged beyond a number of rows.
    """
    keys = parent.select(F.col(key).alias(f"_{flag}_k"))
    if not unique:
        keys = keys.distinct()
    keys = keys.withColumn(flag, F.lit(True))
    if unique:
        keys = keys.hint("merge")
    elif stored:
        keys = bounded(keys, of=parent)
    if broadcast:
        keys = F.broadcast(keys)
    return df.join(keys, df[key] == keys[f"_{flag}_k"], "left").drop(f"_{flag}_k")


def _checked_lines(raw: DataFrame | Lines, parent: DataFrame, key: str, flag: str, unique: bool = False) -> DataFrame:
    """``_fk_flag`` of a raw fact table.  Of ``Lines`` the narrow rows are checked and dealt out by month,
    so that no shuffle or sort carries the columns worked out from them; their parent is stored, so its rows are counted."""
    if isinstance(raw, DataFrame):
        return _fk_flag(raw, parent, key, flag, unique=unique)
    return raw.dealt(_fk_flag(raw.rows, parent, key, flag, unique=unique, stored=True).drop(key), flag)


# ---------------------------------------------------------------- dimensions

def _percentile(alive: DataFrame, column: str, q: float, persist=None) -> float | None:
    """An exact percentile of one column, which ``persist`` may store for the passes over it."""
    lean = alive.select(column)
    if persist is not None:
        lean = persist(f"values_of_{column}", lean)
    return column_percentiles(lean, {column: [q]})[column][0]


def clean_stores(raw: DataFrame, as_of: str = AS_OF["stores"], observe: bool = False):
    lat, lon = F.col("latitude"), F.col("longitude")
    bad_coord = ~F.coalesce(lat.between(8.0, 37.0), F.lit(False)) | \
        ~F.coalesce(lon.between(68.0, 97.0), F.lit(False))
    rules = [
        Rule("audit", "Coordinates outside the service area", "Flagged for review", bad_coord),
        Rule("remove", "Fixed cost not positive", "Rows removed", F.col("monthly_fixed_cost_inr") > 0),
        Rule("derive", "Derived columns", "store_age_days, cost_per_sqft added; city title-cased",
             updates={
                 "store_age_days": F.datediff(F.lit(as_of).cast("date"), F.col("launch_date")),
                 "cost_per_sqft": exact_round(safe_div("monthly_fixed_cost_inr", "store_area_sqft"), 2),
                 "city": title_case(F.trim(F.col("city"))),
             }),
    ]
    return run_rules(raw, "dim_stores", rules, observe)


def clean_skus(raw: DataFrame, observe: bool = False):
    price, cost, mrp = F.col("unit_price_inr"), F.col("cost_price_inr"), F.col("mrp_inr")
    # updates are evaluated on every row (dead rows too): divisions are null-safe
    margin = exact_round(safe_div(price.cast("double") - cost.cast("double"), price), 4)
    rules = [
        Rule("remove", "Unit price not positive", "Rows removed", price > 0),
        Rule("repair", "Cost at or above selling price", "Cost set to 80% of selling price",
             cost >= price, updates={"cost_price_inr": F.when(cost >= price, round_dec(price * DEC("0.80")))
                                     .otherwise(cost)}),
        Rule("repair", "MRP below selling price", "MRP set to 110% of selling price",
             mrp < price, updates={"mrp_inr": F.when(mrp < price, round_dec(price * DEC("1.10"))).otherwise(mrp)}),
        Rule("derive", "Margin and normalised labels", "columns recomputed", audited=False,
             updates={
                 "gross_margin_pct_actual": margin,
                 "category": F.trim(F.col("category")),
                 "velocity_class": F.upper(F.trim(F.col("velocity_class"))),
                 "sku_name": F.trim(F.col("sku_name")),
             }),
        Rule("derive", "High-margin flag", "is_high_margin added", audited=False,
             updates={"is_high_margin": F.col("gross_margin_pct_actual") > 0.30}),
        Rule("remove", "Shelf life not positive", "Rows removed", F.col("shelf_life_days") > 0),
        Rule("derive", "Derived columns", "gross_margin_pct_actual, is_high_margin added"),
    ]
    return run_rules(raw, "dim_skus", rules, observe)


def clean_customers(raw: DataFrame, as_of: str = AS_OF["customers"], observe: bool = False, persist=None):
    basket = F.col("avg_basket_size_inr")
    asof = F.lit(as_of).cast("date")
    rules = [
        Rule("remove", "Signup date in the future", "Rows removed", F.col("signup_date") <= asof),
        Rule("remove", "Basket size not positive", "Rows removed", basket > 0),
        Rule("repair", "Basket size above the 99th percentile", "Capped at the 99th percentile",
             basket > F.col("_p99"),
             stats_fn=lambda alive: {"_p99": _percentile(alive, "avg_basket_size_inr", 0.99, persist)},
             updates={"avg_basket_size_inr": F.when(basket > F.col("_p99"), round_dec(F.col("_p99")))
                      .otherwise(basket)}),
        Rule("repair", "Negative lifetime orders", "Set to 0", F.col("lifetime_orders") < 0,
             updates={"lifetime_orders": F.greatest(F.col("lifetime_orders"), F.lit(0))}),
        Rule("derive", "Normalised columns", "city, segment, email normalised", audited=False,
             updates={
                 "tenure_days": F.datediff(asof, F.col("signup_date")),
                 "city": title_case(F.trim(F.col("city"))),
                 "customer_segment": F.trim(F.col("customer_segment")),
                 "email": F.trim(F.lower(F.col("email"))),
             }),
        Rule("dedup", "Duplicate emails", "Kept first occurrence", key=["email"], order=["customer_id"]),
        Rule("derive", "Derived columns", "tenure_days added"),
    ]
    return run_rules(raw, "dim_customers", rules, observe, persist)


def clean_pickers(raw: DataFrame, stores_clean: DataFrame,
                  as_of: str = AS_OF["pickers"], observe: bool = False, persist=None):
    sal = F.col("monthly_salary_inr")
    asof = F.lit(as_of).cast("date")
    bad_sal = ~F.coalesce(sal.between(10000, 35000), F.lit(False))
    df = _fk_flag(raw, stores_clean, "store_id", "_store_ok", broadcast=True)
    rules = [
        Rule("remove", "Join date in the future", "Rows removed", F.col("join_date") <= asof),
        Rule("repair", "Salary out of range", "Replaced with median salary", bad_sal,
             stats_fn=lambda alive: {"_med": _percentile(alive, "monthly_salary_inr", 0.5, persist)},
             updates={"monthly_salary_inr": F.when(bad_sal, exact_round(F.col("_med"), 0).cast("bigint"))
                      .otherwise(sal)}),
        Rule("remove", "Store not found", "Rows removed", F.col("_store_ok")),
        Rule("derive", "Experience recalculated from join date", "experience_months, annual_cost_inr updated",
             updates={
                 "experience_months": F.floor(F.datediff(asof, F.col("join_date")) / 30).cast("int"),
                 "annual_cost_inr": (F.col("monthly_salary_inr") * 12).cast("bigint"),
             }),
    ]
    clean, audit = run_rules(df, "dim_pickers", rules, observe)
    return clean.drop("_store_ok"), audit


# ---------------------------------------------------------------- facts

TIME_COLS = ["pick_time_mins", "pack_time_mins", "dispatch_time_mins", "travel_time_mins"]


def _medians(alive: DataFrame) -> dict[str, float | None]:
    """The exact median of each time component, which is independent of the others' repair."""
    return {f"_med_{c}": m for c, (m,) in column_percentiles(alive, {c: [0.5] for c in TIME_COLS}).items()}


def _any_disc(disc: Column):
    """Whether any delivery time differs from its components, as 1 or 0."""
    return lambda alive: {"_any_disc": float(bool(alive.agg(F.max(disc)).first()[0]))}


def clean_orders(raw: DataFrame | Lines, stores_clean: DataFrame,
                 sla_minutes: float = 10.0, max_minutes: float = 120.0, observe: bool = False,
                 persist=None):
    lines = raw if isinstance(raw, Lines) and observe and persist is not None else None
    raw = raw.df if isinstance(raw, Lines) else raw
    df = _fk_flag(raw if lines is None else lines.rows.select("*", *lines.columns), stores_clean, "store_id", "_store_ok", broadcast=True)
    order_cols = ["order_timestamp"] + [c for c in raw.columns if c not in ("order_id", "order_timestamp")]
    total = F.col("total_delivery_mins")
    recalc = sum((F.col(c) for c in TIME_COLS[1:]), F.col(TIME_COLS[0])).cast("decimal(9,2)")
    disc = F.abs(total - recalc) > 0.5
    value, discount = F.col("order_value_inr"), F.col("discount_amount_inr")
    rules = [
        Rule("dedup", "Duplicate order ids", "Kept first occurrence", key=["order_id"], order=order_cols),
        Rule("remove", "Order value not positive", "Rows removed", value > 0),
    ]
    for j, c in enumerate(TIME_COLS):
        rules.append(Rule(
            "repair", f"Negative {c}", "Replaced with median", F.col(c) < 0,
            stats_fn=_medians if j == 0 else None,
            updates={c: F.when(F.col(c) < 0, round_dec(F.col(f"_med_{c}"), 2, 9)).otherwise(F.col(c))}))
    rules += [
        Rule("repair", "Delivery time differs from its components", "Recalculated from components",
             disc, stats_fn=_any_disc(disc),
             updates={"total_delivery_mins": F.when(F.col("_any_disc") > 0, recalc)
                      .otherwise(total)}),
        Rule("derive", "SLA flag recalculated", f"sla_met = total_delivery_mins <= {sla_minutes:g}",
             updates={"sla_met": total <= sla_minutes}),
        Rule("remove", f"Delivery time above {max_minutes:g} minutes", "Rows removed", total <= max_minutes),
        Rule("repair", "Discount at or above order value", "Discount set to 0", discount >= value,
             updates={"discount_amount_inr": F.when(discount >= value, F.lit(0).cast("decimal(18,2)"))
                      .otherwise(discount)}),
        Rule("remove", "Store not found", "Rows removed", F.col("_store_ok")),
        Rule("derive", "Derived columns", "gross_profit_inr, is_profitable, bands added",
             updates={
                 "gross_profit_inr": round_dec(F.col("net_order_value_inr") - F.col("delivery_cost_inr")),
                 "order_hour_band": band_left_closed("order_hour", HOUR_BAND_EDGES, HOUR_BAND_LABELS),
                 "delivery_speed_band": band_left_closed(total, SPEED_BAND_EDGES, SPEED_BAND_LABELS),
             }),
        Rule("derive", "Profit flag", "is_profitable added", audited=False,
             updates={"is_profitable": F.col("gross_profit_inr") > 0}),
    ]
    clean, audit = run_rules(df, "fact_orders", rules, observe, persist, lines)
    return clean.drop("_store_ok"), audit


def clean_order_items(raw: DataFrame | Lines, orders_clean: DataFrame, observe: bool = False):
    df = _checked_lines(raw, orders_clean, "order_id", "_order_ok", unique=True)
    price, cost, qty = F.col("unit_price_inr"), F.col("unit_cost_inr"), F.col("quantity")
    rules = [
        Rule("remove", "Quantity not positive", "Rows removed", qty > 0, audited=False),
        Rule("remove", "Unit price not positive", "Rows removed", price > 0, audited=False),
        Rule("derive", "Recomputed totals", "item_total_inr, item_margin_inr", audited=False,
             updates={"item_total_inr": round_dec(price * qty),
                      "item_margin_inr": round_dec((price - cost) * qty)}),
        Rule("remove", "Orphan items", "Rows removed", F.col("_order_ok")),
        Rule("derive", "Margin share", "item_margin_pct added", audited=False,
             updates={"item_margin_pct": exact_round(safe_div("item_margin_inr", "item_total_inr"), 4)}),
    ]
    clean, audit = run_rules(df, "fact_order_items", rules, observe)
    return clean.drop("_order_ok"), audit


def clean_picker_activity(raw: DataFrame | Lines, pickers_clean: DataFrame,
                          max_rate: float = 20.0, observe: bool = False):
    df = _checked_lines(raw, pickers_clean, "picker_id", "_picker_ok")
    rate = F.col("pick_rate_per_min")
    rules = [
        Rule("remove", "Duration not positive", "Rows removed", F.col("pick_duration_mins") > 0,
             audited=False),
        Rule("repair", f"Pick rate above {max_rate:g} items/min", f"Capped at {max_rate:g}",
             rate > max_rate, updates={"pick_rate_per_min": F.least(rate, F.lit(max_rate))}),
        Rule("remove", "Picker not found", "Rows removed", F.col("_picker_ok")),
        Rule("derive", "Productivity band", "productivity_band added", audited=False,
             updates={"productivity_band": band_right_closed(rate, PRODUCTIVITY_EDGES, PRODUCTIVITY_LABELS)}),
    ]
    clean, audit = run_rules(df, "fact_picker_activity", rules, observe)
    return clean.drop("_picker_ok"), audit


def clean_substitutions(raw: DataFrame | Lines, orders_clean: DataFrame, observe: bool = False):
    df = _checked_lines(raw, orders_clean, "order_id", "_order_ok", unique=True)
    acc = F.col("customer_accepted")
    rules = [
        Rule("remove", "Original equals substitute SKU", "Rows removed",
             F.col("original_sku_id") != F.col("substitute_sku_id")),
        Rule("remove", "Orphan substitutions", "Rows removed", F.col("_order_ok")),
        Rule("derive", "Acceptance label", "acceptance_label added", audited=False,
             updates={"acceptance_label": F.when(acc, "Accepted").when(~acc, "Rejected")}),
    ]
    clean, audit = run_rules(df, "fact_substitutions", rules, observe)
    return clean.drop("_order_ok"), audit


# ---------------------------------------------------------------- whole set

def clean_all(raw: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Clean the eight tables in dependency order; return (tables, audit)."""
    out, audits = {}, []
    out["dim_stores"], a = clean_stores(raw["dim_stores"]); audits.append(a)
    out["dim_skus"], a = clean_skus(raw["dim_skus"]); audits.append(a)
    out["dim_customers"], a = clean_customers(raw["dim_customers"]); audits.append(a)
    out["dim_pickers"], a = clean_pickers(raw["dim_pickers"], out["dim_stores"]); audits.append(a)
    out["fact_orders"], a = clean_orders(raw["fact_orders"], out["dim_stores"]); audits.append(a)
    out["fact_order_items"], a = clean_order_items(raw["fact_order_items"], out["fact_orders"])
    audits.append(a)
    out["fact_picker_activity"], a = clean_picker_activity(raw["fact_picker_activity"], out["dim_pickers"])
    audits.append(a)
    out["fact_substitutions"], a = clean_substitutions(raw["fact_substitutions"], out["fact_orders"])
    audits.append(a)
    audit = audits[0]
    for a in audits[1:]:
        audit = audit.unionByName(a)
    return out, audit


#: How each table is cleaned and the cleaned tables that it needs, in the order of the audit.
STEPS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "dim_stores": (clean_stores, ()), "dim_skus": (clean_skus, ()), "dim_customers": (clean_customers, ()),
    "dim_pickers": (clean_pickers, ("dim_stores",)), "fact_orders": (clean_orders, ("dim_stores",)),
    "fact_order_items": (clean_order_items, ("fact_orders",)), "fact_picker_activity": (clean_picker_activity, ("dim_pickers",)),
    "fact_substitutions": (clean_substitutions, ("fact_orders",)),
}


def with_parents(names: Iterable[str]) -> list[list[str]]:
    """The tables that cleaning ``names`` takes, in waves: each needs only tables of earlier ones."""
    wanted, add = set(), list(names)
    while add:
        wanted.add(name := add.pop())
        add += [p for p in STEPS[name][1] if p not in wanted]
    waves: list[list[str]] = []
    while left := wanted.difference(*waves):
        waves.append([n for n in STEPS if n in left and not left & {*STEPS[n][1]}])
    return waves


def clean_and_write(name: str, raw: DataFrame | Lines, parents: list[DataFrame], write, stage=None) -> list[tuple]:
    """Clean one table and write it by ``write(df)``; audit counts are observed meanwhile.  Returns the audit rows.

    ``parents`` are the *written* tables that ``STEPS`` names, so that keys are checked without
    cleaning these again, and lineage is cut at every table.
    """
    fn = STEPS[name][0]
    kw = {"persist": stage} if stage is not None and fn in (clean_customers, clean_pickers, clean_orders) else {}
    clean, audit = fn(raw, *parents, observe=True, **kw)
    write(clean)
    return audit.rows()
