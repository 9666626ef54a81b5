from decimal import Decimal

from pyspark.sql import functions as F

from storepulse.functions.exprs import (band_left_closed, band_right_closed, exact_mean, exact_round, fmt_id,
                                        hash_uniform, rate_pct, safe_div)
from storepulse.operators.cleaning import (HOUR_BAND_EDGES, HOUR_BAND_LABELS, PRODUCTIVITY_EDGES,
                                           PRODUCTIVITY_LABELS, SPEED_BAND_EDGES, SPEED_BAND_LABELS)


def _one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_exact_round_half_away_from_zero(spark):
    got = _one(spark, exact_round("x", 2), [(1.005,), (2.675,), (-1.005,), (0.125,)], "x double")
    assert got == [1.01, 2.68, -1.01, 0.13]


def test_exact_mean_is_exact_decimal(spark):
    rows = [(Decimal("0.10"),)] * 3 + [(Decimal("0.20"),)]
    got = _one(spark, F.lit(1), rows, "x decimal(18,2)")
    assert got
    m = spark.createDataFrame(rows, "x decimal(18,2)").agg(exact_mean("x")).collect()[0][0]
    assert m == 0.125


def test_speed_band_edges(spark):
    vals = [0.0, 7.99, 8.0, 10.0, 10.01, 15.0, 25.0, 119.99, 120.0, -0.01]
    got = _one(spark, band_left_closed("x", SPEED_BAND_EDGES, SPEED_BAND_LABELS), [(v,) for v in vals], "x double")
    assert got == ["<8 mins", "<8 mins", "8-10 mins", "10-15 mins", "10-15 mins", "15-25 mins", ">25 mins",
                   ">25 mins", None, None]


def test_hour_band_edges(spark):
    hours = [0, 5, 6, 11, 12, 16, 17, 20, 21, 23]
    got = _one(spark, band_left_closed("h", HOUR_BAND_EDGES, HOUR_BAND_LABELS), [(h,) for h in hours], "h int")
    assert got == ["Late Night", "Late Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening",
                   "Evening", "Night", "Night"]


def test_productivity_band_right_closed(spark):
    rates = [0.0, 0.8, 0.81, 1.2, 1.8, 20.0, 20.5]
    got = _one(spark, band_right_closed("r", PRODUCTIVITY_EDGES, PRODUCTIVITY_LABELS), [(r,) for r in rates],
               "r double")
    assert got == [None, "Low", "Medium", "Medium", "High", "Elite", None]


def test_rate_pct_nulls_are_false_and_zero_denominator(spark):
    df = spark.createDataFrame([(True,), (False,), (None,), (True,)], "b boolean")
    assert df.agg(rate_pct(F.col("b"))).collect()[0][0] == 50.0
    assert df.filter("false").agg(rate_pct(F.col("b"))).collect()[0][0] is None
    assert _one(spark, safe_div("a", "b"), [(1.0, 0.0)], "a double, b double") == [None]


def test_hash_uniform_deterministic_and_in_range(spark):
    df = spark.range(2000).select(hash_uniform(7, F.col("id")).alias("u"))
    a = [r.u for r in df.collect()]
    b = [r.u for r in df.collect()]
    assert a == b and all(0.0 <= u < 1.0 for u in a)
    assert 0.4 < sum(a) / len(a) < 0.6


def test_fmt_id_never_truncates(spark):
    assert _one(spark, fmt_id("SKU_", "k", 6), [(7,), (12345678,)], "k long") == ["SKU_000007", "SKU_12345678"]
