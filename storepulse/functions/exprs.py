"""Column-expression helpers shared by every plan.

All helpers return ``pyspark.sql.Column`` built from built-in functions, so
they stay inside whole-stage codegen; there are no Python UDFs anywhere.

Rounding contract: a plain ``round(double, k)`` rounds some ties differently
from other engines, so every rounded value goes through a decimal(28,10)
cast first (``exact_round``).  Means of money/minutes are computed as an
exact decimal sum divided by the count (``exact_mean``) so they do not depend
on the order in which partitions are summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "exact_round", "round_dec", "exact_mean", "rate_pct", "count_true",
    "safe_div", "band_left_closed", "band_right_closed", "hash_uniform",
    "title_case", "fmt_id", "weekday_name", "is_weekend", "month_start",
    "as_col",
]


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_round(c, k: int = 2) -> Column:
    """Round half away from zero at ``k`` decimals, returned as double."""
    return F.round(as_col(c).cast("decimal(28,10)"), k).cast("double")


def round_dec(c, k: int = 2, precision: int = 18) -> Column:
    """Round half away from zero and keep a decimal(precision, k) type."""
    return F.round(as_col(c).cast("decimal(28,10)"), k).cast(f"decimal({precision},{k})")


def exact_mean(c, scale: int = 2) -> Column:
    """Order-independent mean: exact decimal sum / count, as double.

    ``scale`` is the number of decimals the column carries (2 for money and
    minutes, 4 for rates, 0 for integers).
    """
    col = as_col(c)
    if scale == 0:
        total = F.sum(col.cast("bigint")).cast("double")
    else:
        total = F.sum(col.cast(f"decimal(18,{scale})")).cast("double")
    return total / F.nullif(F.count(col), F.lit(0)).cast("double")


def count_true(pred: Column) -> Column:
    """Number of rows where ``pred`` is true (nulls count as false)."""
    return F.sum(F.when(pred, 1).otherwise(0)).cast("bigint")


def safe_div(num, den) -> Column:
    """num / den as double, null when den is 0 (ANSI mode raises on /0)."""
    return as_col(num).cast("double") / F.nullif(as_col(den).cast("double"), F.lit(0.0))


def rate_pct(pred: Column, denom: Column | None = None) -> Column:
    """100 * (#rows with pred) / (#rows), as double (unrounded)."""
    d = F.count(F.lit(1)) if denom is None else denom
    return count_true(pred).cast("double") * 100.0 / F.nullif(d.cast("double"), F.lit(0.0))


def band_left_closed(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """[e0,e1) -> l0, [e1,e2) -> l1, ...; outside [e0, e_last) -> null."""
    col = as_col(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (col >= lo) & (col < hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def band_right_closed(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """(e0,e1] -> l0, (e1,e2] -> l1, ...; outside (e0, e_last] -> null."""
    col = as_col(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (col > lo) & (col <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def hash_uniform(seed, *parts) -> Column:
    """Deterministic uniform draw in [0, 1) from md5 of the key parts.

    First 8 hex digits of md5(seed|part|...) read as an unsigned 32-bit int,
    divided by 2^32.  Equal inputs give equal draws on every executor, so a
    re-run task (lost executor) reproduces the same sample.
    """
    key = F.concat_ws("|", F.lit(str(seed)), *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint").cast("double") / 4294967296.0


def title_case(c) -> Column:
    """Upper-case the first letter of each space-separated word."""
    return F.initcap(as_col(c))


def fmt_id(prefix: str, c, width: int) -> Column:
    """prefix + zero-padded integer; never truncates wider numbers."""
    return F.format_string(f"{prefix}%0{width}d", as_col(c).cast("bigint"))


def weekday_name(d) -> Column:
    return F.date_format(as_col(d), "EEEE")


def is_weekend(d) -> Column:
    return F.weekday(as_col(d)) >= 5


def month_start(d) -> Column:
    return F.trunc(as_col(d), "month")
