"""The numeric contract of ``functions.exprs`` as Spark SQL functions.

``register_functions`` creates temporary SQL functions, so that a report can be written as SQL
text over the views of a table set.  Spark puts a SQL function's body in place of its call:
plans hold the same built-in expressions as those of the DataFrame reports, and no Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Decimals that ``exact_round`` takes; Spark's ``round`` needs a constant, chosen when the call is folded.
PLACES = range(5)

# name, parameters, result, body; a later one may call an earlier one
FUNCTIONS: list[tuple[str, str, str, str]] = [
    ("exact_round", "x DOUBLE, k INT", "DOUBLE",
     "CASE k " + " ".join(f"WHEN {k} THEN CAST(ROUND(CAST(x AS DECIMAL(28,10)), {k}) AS DOUBLE)" for k in PLACES)
     + " ELSE raise_error('exact_round takes 0 to 4 places') END"),
    ("safe_div", "num DOUBLE, den DOUBLE", "DOUBLE", "num / NULLIF(den, 0D)"),
    ("exact_amount", "x DECIMAL(18,4)", "DECIMAL(18,4)", "x"),
    ("share_pct", "part BIGINT, whole BIGINT", "DOUBLE", "CAST(part AS DOUBLE) * 100D / NULLIF(CAST(whole AS DOUBLE), 0D)"),
    ("time_of_week", "d DATE", "STRING", "CASE WHEN WEEKDAY(d) >= 5 THEN 'Weekend' ELSE 'Weekday' END"),
    ("pnl_status", "avg_profit DOUBLE", "STRING",
     "CASE WHEN avg_profit > 0 THEN 'PROFITABLE' WHEN avg_profit > -50000 THEN 'MARGINAL' ELSE 'LOSS MAKING' END"),
]


def register_functions(spark: SparkSession) -> None:
    """Create, or replace, the functions in the session.

    ``exact_round(x, k)`` rounds half away from zero; ``safe_div`` is null for a denominator of 0;
    ``sum(exact_amount(x))`` over ``count(x)`` through ``safe_div`` is the order-free mean of money,
    minutes or rates; ``share_pct`` is a percentage of counts."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
