"""Exact medians of many columns: only values about the median are ordered."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendspark.operators import prep, profile

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def seen(monkeypatch):
    """Rows of every table of values that is ordered."""
    counts, real = [], profile.collapse

    def spy(*args, **kwargs):
        out = real(*args, **kwargs)
        counts.append(out.count())
        return out
    monkeypatch.setattr(profile, "collapse", spy)
    monkeypatch.setattr("lendspark.operators.ordered.collapse", spy)
    return counts


def test_scaler_orders_values_about_the_median_only(spark, seen):
    n = 40_001
    df = spark.range(n, numPartitions=4).select(
        F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("x"),
        F.when(F.col("id") % 3 > 0, F.sqrt("id")).alias("y"))
    m = prep.NumericImputerScaler(inputCols=["x", "y"], outputCols=["a", "b"]).fit(df)
    y = np.sqrt([i for i in range(n) if i % 3])
    assert m.getOrDefault(m.medians) == pytest.approx([(n - 1) / 2, np.median(y)], abs=0, rel=1e-15)
    assert sum(seen) < n / 10          # before: all of their distinct values


CASES = {"one": [3.0], "two": [1.0, 2.0], "even": [4.0, 1.0, 3.0, 2.0], "holes": [None, 5.0, NAN, 1.0, 2.0, 9.0],
         "ties": [2.0] * 7 + [1.0] * 3 + [9.0] * 3, "ends": [-INF, -INF, 1.0, 4.0, INF], "zero": [-0.0, 0.0, 0.0],
         "three": [0.1, 0.7, 0.2], "empty": [None, NAN]}


@pytest.mark.parametrize("side", [0.005, -0.3, 0.0])     # brackets that miss the median, too
def test_medians_of_odd_columns(spark, monkeypatch, side):
    monkeypatch.setattr(profile, "MEDIAN_SIDE", side)
    longest = max(map(len, CASES.values()))
    rows = list(zip(*[v + [None] * (longest - len(v)) for v in CASES.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in CASES))
    got = profile.column_medians(df, list(CASES))
    want = {c: float(np.median(k)) for c, v in CASES.items() if (k := [x for x in v if x is not None and x == x])}
    assert got == want
