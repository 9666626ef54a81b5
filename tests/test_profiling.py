"""Duplicate rows by digest against plain counting."""

from pyspark.sql import functions as F

from storepulse.operators import profiling
from storepulse.operators.profiling import profile_duplicates


def _plain(df):
    return df.count(), df.distinct().count()


def _found(df):
    r = profile_duplicates(df, "t").first()
    return r.rows, r.distinct_rows, r.duplicate_rows


def _check(df):
    rows, distinct = _plain(df)
    assert _found(df) == (rows, distinct, rows - distinct)


def test_nulls_in_different_columns_are_different_rows(spark):
    _check(spark.createDataFrame([("a", None), (None, "a"), ("a", None), (None, None), (None, None), ("", None)], "x string, y string"))


def test_zeros_of_either_sign_and_nan(spark):
    _check(spark.createDataFrame([(0.0, 1), (-0.0, 1), (float("nan"), 1), (float("nan"), 1), (None, 1)], "x double, y int"))


def test_empty_table(spark):
    assert _found(spark.createDataFrame([], "x string, y int")) == (0, 0, 0)


def test_a_hot_row_and_columns_of_odd_names(spark):
    hot = F.col("id") % 3 > 0
    df = spark.range(3000).select(F.when(hot, F.col("id") % 700).alias("a.b"), F.lit("x").alias("d1"),
                                  F.when(hot, F.col("id") % 2).alias("n"))
    rows, distinct = 3000, df.toDF("x", "y", "z").distinct().count()
    assert _found(df) == (rows, distinct, rows - distinct)


def test_colliding_digests_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(profiling, "_row_digest", lambda cols: [F.lit(1).alias("d1"), (F.col(cols[0]) % 3).alias("d2")])
    _check(spark.range(300).select((F.col("id") % 40).alias("x"), F.lit("y").alias("y")))


def test_no_row_is_shuffled_but_those_of_repeated_digests(spark):
    df = spark.range(100).select(*[F.concat(F.lit("w" * 50), F.col("id").cast("string")).alias(f"c{i}") for i in range(20)])
    plan = profile_duplicates(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan
    assert sum("Aggregate [d1" in line for line in plan.split("\n")) == 2
