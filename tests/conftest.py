"""Shared fixtures: one local SparkSession and the small credit frames."""

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lendspark.functions.scalar import SENTINEL_DAYS_EMPLOYED  # noqa: E402
from lendspark.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", shuffle_partitions=8,
                  extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="lendspark-wh-")})
    yield s


MINIMAL_COLS = "DAYS_EMPLOYED long, DAYS_BIRTH long, AMT_CREDIT long, AMT_INCOME_TOTAL long, " \
               "AMT_ANNUITY long, CNT_FAM_MEMBERS long"
MINIMAL_ROWS = list(zip(
    [SENTINEL_DAYS_EMPLOYED, SENTINEL_DAYS_EMPLOYED, -1000, -500, -200, -800, -1500, -300, -600, -900],
    [-12000, -15000, -10000, -8000, -20000, -14000, -11000, -9000, -13000, -16000],
    [500000, 300000, 200000, 150000, 800000, 450000, 350000, 250000, 600000, 400000],
    [100000, 80000, 60000, 50000, 150000, 90000, 70000, 55000, 110000, 85000],
    [25000, 15000, 10000, 8000, 40000, 22000, 17000, 12000, 30000, 20000],
    [2, 3, 1, 4, 2, 3, 2, 1, 3, 4],
))


@pytest.fixture
def df_minimal(spark):
    """10 rows, 2 sentinels."""
    return spark.createDataFrame(MINIMAL_ROWS, MINIMAL_COLS)


@pytest.fixture
def df_with_target(spark):
    target = [1, 0, 0, 1, 0, 0, 1, 0, 0, 1]
    gender = ["M", "F"] * 5
    income_type = ["Working", "Commercial", "Working", "Pensioner", "Working", "Commercial",
                   "Working", "Pensioner", "Working", "Commercial"]
    rows = [r + (t, g, i) for r, t, g, i in zip(MINIMAL_ROWS, target, gender, income_type)]
    return spark.createDataFrame(
        rows, MINIMAL_COLS + ", TARGET int, CODE_GENDER string, NAME_INCOME_TYPE string")


@pytest.fixture
def df_isolated_anomaly(spark):
    rows = list(zip([SENTINEL_DAYS_EMPLOYED, -500, -1000], [-10000, -12000, -15000],
                    [200000, 300000, 400000], [80000, 100000, 120000], [10000, 15000, 20000],
                    [2, 3, 4]))
    return spark.createDataFrame(rows, MINIMAL_COLS)
