"""Profiles of many columns in one scan, and the small helpers of the profile and charts."""

from pyspark.sql import functions as F

from lendspark.functions import nulls
from lendspark.operators import charts, profile as prof


def test_many_columns_in_one_scan(spark):
    names = [f"c{i}" for i in range(250)]
    df = spark.range(6).select(*[F.when(F.col("id") < i % 5, F.col("id").cast("double")).alias(n)
                                 for i, n in enumerate(names)])
    out = prof.null_profile(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    got = {r.coluna: r.n_nulos for r in out.collect()}
    assert got == {n: 6 - i % 5 for i, n in enumerate(names)}


def test_dtype_counts_and_external_scores(spark):
    df = spark.createDataFrame([(1, 2.0, "a", 0.5)], "a long, b double, s string, EXT_SOURCE_2 double")
    assert {r.dtype: r.n_columns for r in prof.dtype_counts(df).collect()} == {"bigint": 1, "double": 2, "string": 1}
    assert charts.external_scores(df) == ["EXT_SOURCE_2"]


def test_category_rates_and_class_medians(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 0, 1.0), ("b", 0, 2.0), ("b", 0, 4.0), (None, 1, 7.0)],
                               "k string, TARGET int, x double")
    rates = charts.category_rates(df, "k").collect()
    assert len(rates) >= 2
    assert {r.TARGET: r["median"] for r in charts.class_medians_of(df, "x").collect()} == {0: 2.0, 1: 6.0}


def test_null_helpers(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(nulls.zero_to_null("a")).collect()] == [None, 1.0, None]
    assert [r[0] for r in df.select(nulls.is_equal_null_safe("a", 1.0)).collect()] == [False, True, False]
