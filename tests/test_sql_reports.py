"""SQL text over the views of a table set, and the numeric contract as SQL functions."""

from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from storepulse.functions import exprs
from storepulse.functions.sql import register_functions
from storepulse.plans.sql_reports import REPORTS, run_sql


@pytest.mark.parametrize("k", range(5))
def test_exact_round_is_that_of_the_dataframe_reports(spark, k):
    register_functions(spark)
    values = spark.createDataFrame([(x,) for x in [0.5, 1.5, -2.5, 2.675, 1.00005, -0.00005, 12345.67895, 0.0, None]], "x double")
    values.createOrReplaceTempView("rounded_values")
    got = [r[0] for r in spark.sql(f"SELECT exact_round(x, {k}) FROM rounded_values").collect()]
    assert got == [r[0] for r in values.select(exprs.exact_round("x", k)).collect()]


def test_divisions_by_zero_and_nulls_are_null(spark):
    register_functions(spark)
    row = spark.sql("SELECT safe_div(1, 0), safe_div(null, 2), share_pct(1, 0), share_pct(1, 4), exact_round(null, 2)").first()
    assert tuple(row) == (None, None, None, 25.0, None)


def test_places_beyond_the_constants_are_refused(spark):
    register_functions(spark)
    with pytest.raises(PySparkException, match="0 to 4 places"):
        spark.sql("SELECT exact_round(1.5D, 7)").collect()


def test_mean_and_bands_equal_those_of_the_dataframe_reports(spark):
    money = spark.createDataFrame([(Decimal(f"{i}.{i % 100:02d}"), i % 3) for i in range(200)] + [(None, 0), (None, 3)], "m decimal(18,2), g int")
    got = run_sql({"money": money}, "SELECT g, safe_div(SUM(exact_amount(m)), COUNT(m)) AS mean FROM money GROUP BY g")
    want = money.groupBy("g").agg(exprs.exact_mean("m").alias("mean"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    days = spark.sql("SELECT time_of_week(DATE'2024-01-06'), time_of_week(DATE'2024-01-08'), pnl_status(-50000), pnl_status(1)")
    assert tuple(days.first()) == ("Weekend", "Weekday", "LOSS MAKING", "PROFITABLE")


def test_values_are_bound_and_not_pasted(spark, small_tables):
    _, T = small_tables
    text = "SELECT COUNT(*) AS n FROM dim_stores WHERE city = :city"
    assert run_sql(T, text, {"city": "Asia' OR '1' = '1"}).first().n == 0
    assert run_sql(T, text, {"city": "Asia"}).first().n == T["dim_stores"].where(F.col("city") == "Asia").count()


def test_a_result_keeps_its_tables_when_others_take_their_names(spark):
    first = run_sql({"t": spark.range(3).toDF("x")}, "SELECT SUM(x) AS s FROM t")
    second = run_sql({"t": spark.range(10).toDF("x")}, "SELECT SUM(x) AS s FROM t")
    assert (first.first().s, second.first().s) == (3, 45)


def test_filters_and_columns_reach_the_files(spark, small_tables):
    _, T = small_tables
    plan = run_sql(T, REPORTS["sql_store_pnl_summary"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(order_status), EqualTo(order_status,Delivered)" in plan
    assert "customer_id" not in plan and "Python" not in plan
