"""Missing-value rules shared by every operator.

pandas treats NaN as missing; Spark keeps NaN as a value (``NaN > 0`` is true,
``NaN = NaN`` is true). The helpers below make the pandas semantics explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN -> null; other values unchanged."""
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def nans_to_nulls(df: DataFrame) -> DataFrame:
    """Ingest rule: every float/double NaN becomes null (one projection)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            exprs.append(nan_to_null(F.col(f"`{f.name}`")).alias(f.name))
        else:
            exprs.append(F.col(f"`{f.name}`"))
    return df.select(*exprs)


def zero_to_null(c: str | Column) -> Column:
    """``replace(0, nan)``: zero denominators become missing."""
    return F.nullif(col_of(c), F.lit(0))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double; null when den is null or 0 (never raises under ANSI)."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))


def floor_at_zero(c: str | Column) -> Column:
    """``clip(lower=0)`` keeping nulls (``greatest`` would turn null into 0)."""
    c = col_of(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c.cast("double"))


def sum_or_zero(c: str | Column) -> Column:
    """pandas ``sum`` of an empty / all-null group is 0."""
    return F.coalesce(F.sum(col_of(c)), F.lit(0))


def is_equal_null_safe(c: str | Column, value) -> Column:
    """Comparison where null compares false (pandas ``==`` on NaN)."""
    return col_of(c).eqNullSafe(F.lit(value))


# Relative nudge applied before rounding: far above double rounding noise
# (~1e-16 relative), far below the rounding step. It makes a value that sits on
# a decimal tie round the same way however its sum was ordered.
TIE_NUDGE = 1e-12


def round_half_even(c: str | Column, scale: int) -> Column:
    """numpy-style ``round``: ``rint(x * 10^s) / 10^s`` on the binary value
    (pandas ``.round`` does the same), with the tie nudge above."""
    x = col_of(c).cast("double")
    p = F.lit(10.0 ** scale)
    return F.rint((x + F.abs(x) * F.lit(TIE_NUDGE)) * p) / p


def stable_round_sql(sql: str) -> str:
    """Rewrite ``round_even(expr, s)`` in oracle SQL into the same nudged form
    as :func:`round_half_even` (DuckDB's ``round_even`` on doubles is
    ``rint(x * 10^s) / 10^s``)."""
    out, i, key = [], 0, "round_even("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth, comma = j + len(key), 1, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = stable_round_sql(sql[j + len(key):comma])
        scale = sql[comma + 1:k - 1].strip()
        out.append(f"round_even(({inner}) + abs({inner}) * {TIE_NUDGE}, {scale})")
        i = k
