"""Radix selection against Spark's own exact percentile."""

import math
from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storepulse.operators.selection import column_percentiles, day, key_value, order_key

QS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.0, 2.0 - 2**-52, 2.0, 2.0 + 2**-51, 0.5 - 2**-54, 3.0, 1e308,
         -1e308, float("inf"), float("-inf"), float("nan"), 1 / 3, -1 / 3, 0.1, 1e-300, 4503599627370497.5]


def percentile(df, c):
    return df.agg(F.percentile(F.col(c).cast("double"), QS)).first()[0]


def close(got, want):
    return got == pytest.approx(want, rel=1e-12, nan_ok=True)


def test_double_keys_are_the_bits_in_order(spark):
    import random
    rng = random.Random(4)
    values = EDGES + [rng.gauss(0, 1) * 10 ** rng.randint(-320, 300) for _ in range(3000)] + [2.0**e for e in range(-1074, 1024, 7)]
    values += [math.nextafter(2.0**e, s) for e in range(-1070, 1023, 11) for s in (0, math.inf)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, key in df.select("v", order_key(F.col("v"), T.DoubleType())).collect():
        back = key_value(key, T.DoubleType())
        assert back == v or math.isnan(back) and math.isnan(v)
    rows = [r for r in df.select("v", order_key(F.col("v"), T.DoubleType()).alias("k")).collect() if not math.isnan(r.v)]
    assert [r.v for r in sorted(rows, key=lambda r: r.k)] == sorted(r.v for r in rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False, min_value=-1e200, max_value=1e200)),
                     min_size=1, max_size=60), bits=st.sampled_from([3, 12]))
def test_equals_percentile_on_doubles(spark, vals, bits):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = column_percentiles(df, {"v": QS}, bits)["v"]
    want = percentile(df, "v")
    assert got == [None] * 6 if want is None else close(got, want)


def test_every_type_at_once(spark):
    schema = "a tinyint, b int, c bigint, d decimal(9,2), e decimal(18,4), f float, g double, h date, i timestamp_ntz, j bigint"
    from datetime import datetime
    rows = [((i * 37) % 256 - 128, i * i - 900, (i - 30) * 2**55, Decimal(i * 7 % 100) / 4, Decimal(i - 50) * 10**12, i / 3, math.sin(i) * 10**i,
             date(1960 + i, 1, 1 + i % 28), datetime(1960 + i, 5, 6, 7, 8, 9, i), None) for i in range(60)] + [(None,) * 10] * 7
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = column_percentiles(df, {c: QS for c in df.columns})
    for c in "abcdefg":
        assert close(got[c], percentile(df, c)), c
    assert [day(v) for v in (got["h"][0], got["h"][-1])] == [date(1960, 1, 1), date(2019, 1, 4)]
    assert got["j"] == [None] * 6 and got["i"][0] < got["i"][2] < got["i"][-1]


def test_one_value_holds_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("decimal(18,2)").alias("v"))
    assert close(column_percentiles(df, {"v": QS})["v"], percentile(df, "v"))


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "v double, w int")
    assert column_percentiles(df, {"v": [0.5], "w": [0.1, 0.9]}) == {"v": [None], "w": [None, None]}
    assert column_percentiles(spark.createDataFrame([(3,)], "w int"), {"w": [0.5]}) == {"w": [3.0]}


def test_few_passes_over_many_distinct_values(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 1_000_003).alias("v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("selection", "")
    got = column_percentiles(df, {"v": [0.5]})["v"][0]
    jobs = tracker.getJobIdsForGroup("selection")
    spark.sparkContext.setJobGroup("tests", "")
    assert got == percentile(df, "v")[2] and len(jobs) <= 12


def test_wide_decimals_are_refused(spark):
    with pytest.raises(ValueError):
        column_percentiles(spark.createDataFrame([(Decimal(1),)], "v decimal(28,10)"), {"v": [0.5]})
