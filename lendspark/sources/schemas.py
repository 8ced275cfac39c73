"""Schemas and row-level constraints.

The scoring input is validated set-wise: every constraint becomes a boolean
expression, failures are collected into an ``errors array<string>`` column,
and the frame splits into valid and rejected rows (no per-row Python).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scoring input (17 fields): (name, type, required, constraint)
# constraint: ("gt", 0) / ("lt", 0) / ("ge", 1) / None
APPLICATION_FIELDS = [
    ("AMT_CREDIT", T.DoubleType(), True, ("gt", 0)),
    ("AMT_ANNUITY", T.DoubleType(), False, ("gt", 0)),
    ("AMT_INCOME_TOTAL", T.DoubleType(), True, ("gt", 0)),
    ("AMT_GOODS_PRICE", T.DoubleType(), False, ("gt", 0)),
    ("DAYS_BIRTH", T.IntegerType(), True, ("lt", 0)),
    ("DAYS_EMPLOYED", T.IntegerType(), True, None),
    ("DAYS_REGISTRATION", T.DoubleType(), True, None),
    ("DAYS_ID_PUBLISH", T.IntegerType(), True, ("lt", 0)),
    ("CNT_FAM_MEMBERS", T.DoubleType(), False, ("ge", 1)),
    ("CODE_GENDER", T.StringType(), False, None),
    ("FLAG_OWN_CAR", T.StringType(), False, None),
    ("FLAG_OWN_REALTY", T.StringType(), False, None),
    ("NAME_INCOME_TYPE", T.StringType(), False, None),
    ("NAME_EDUCATION_TYPE", T.StringType(), False, None),
    ("NAME_FAMILY_STATUS", T.StringType(), False, None),
    ("NAME_HOUSING_TYPE", T.StringType(), False, None),
    ("OCCUPATION_TYPE", T.StringType(), False, None),
]

APPLICATION_SCHEMA = T.StructType(
    [T.StructField("SK_ID_CURR", T.LongType(), True)]
    + [T.StructField(n, t, True) for n, t, _, _ in APPLICATION_FIELDS])

PREDICTION_SCHEMA = T.StructType([
    T.StructField("probability_default", T.DoubleType(), False),
    T.StructField("decision", T.StringType(), False),
    T.StructField("score_band", T.StringType(), False),
    T.StructField("threshold", T.DoubleType(), False),
])

MAX_BATCH_ROWS = 1000


def _violation(name: str, required: bool, rule) -> list[Column]:
    c = F.col(name)
    checks = []
    if required:
        checks.append(F.when(c.isNull(), F.lit(f"{name}: required")))
    if rule is not None:
        op, v = rule
        bad = {"gt": c <= v, "lt": c >= v, "ge": c < v}[op]
        sym = {"gt": ">", "lt": "<", "ge": ">="}[op]
        checks.append(F.when(c.isNotNull() & bad, F.lit(f"{name}: must be {sym} {v}")))
    return checks


def constraint_errors(fields=APPLICATION_FIELDS, present: list[str] | None = None) -> Column:
    """``errors``: array of messages for the failed constraints (empty = valid)."""
    checks = []
    for name, _, required, rule in fields:
        if present is not None and name not in present:
            if required:
                checks.append(F.lit(f"{name}: required"))
            continue
        checks += _violation(name, required, rule)
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate(df: DataFrame, fields=APPLICATION_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``errors``)."""
    checked = df.withColumn("errors", constraint_errors(fields, df.columns))
    valid = checked.where(F.size("errors") == 0).drop("errors")
    rejected = checked.where(F.size("errors") > 0)
    return valid, rejected


def check_batch_size(df: DataFrame, max_rows: int = MAX_BATCH_ROWS, min_rows: int = 1) -> int:
    """Raise unless min_rows <= rows <= max_rows; counts at most
    max_rows + 1 rows."""
    n = df.limit(max_rows + 1).count()
    if n < min_rows or n > max_rows:
        raise ValueError(f"Batch must have between {min_rows} and {max_rows} rows (got "
                         f"{'more than ' + str(max_rows) if n > max_rows else n}).")
    return n
