"""Correlation and association with the label.

Every measure covers all requested columns in one job: Pearson is one
aggregate of ``corr`` expressions; rank-based measures (Spearman, Kendall)
unpivot to ``(column, value, label)`` and use the distributed ordered counts,
so no column's values pass through a single task. p-values are computed by an
Arrow-batched pandas UDF on the per-column scalars.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lendspark.functions import tails
from lendspark.functions.nulls import nan_to_null, round_half_even
from lendspark.operators.concordance import tau_b
from lendspark.operators.gram import pair_correlations
from lendspark.operators.ordered import SMALL_TABLE, ordered_counts
from lendspark.session import cut_lineage, ship_package
from lendspark.operators.profile import TARGET, _q, _wide_to_long, long_values, numeric_columns

# Distinct values of one slice of the value order that one task ranks
SLICE_VALUES = 500_000


def _pearson_long(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    def per_col(c):
        x, y = _q(c).cast("double"), _q(target).cast("double")
        both = x.isNotNull() & y.isNotNull()
        return {"corr": F.corr(x, y), "n": F.count_if(both)}
    return _wide_to_long(df, list(columns), per_col)


def _slice_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each column's values in one slice: the lowest, the rows ``k``, and about the mean of
    their ranks within the slice the squares of those ranks and their products with the label's."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table)
    for column in pc.unique(table["column"]).to_pylist():
        t = table.filter(pc.equal(table["column"], column))
        v, n, sy = (t[c].to_numpy() for c in ("value", "n", "sy"))
        order = np.argsort(v)
        n, sy = n[order].astype(np.float64), sy[order]
        k = n.sum()
        d = np.cumsum(n) - (n - 1) / 2 - (k + 1) / 2
        yield pa.RecordBatch.from_pydict({"column": [column], "low": [float(v[order[0]])], "k": [k], "sy": [float(sy.sum())],
                                          "dd": [float(np.sum(n * d * d))], "dy": [float(np.sum(d * sy))]})


def _spearman_long(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson of average ranks over complete pairs, per column; the label is ranked
    like the values, so it may be any numeric column. The label's ranks (about their mean)
    are summed for every distinct value; the values are then ranked in slices of the value
    order, which meet as a few sums each."""
    ship_package(df.sparkSession)
    y = nan_to_null(_q(target).cast("double"))
    lv = long_values(df.withColumn(target, y).where(_q(target).isNotNull()), columns, keep=[target]) \
        .withColumnRenamed(target, "_y")
    labels = cut_lineage(lv.groupBy("column", "_y").agg(F.count(F.lit(1)).alias("n")))
    labels = cut_lineage(ordered_counts(None, "_y", groups=["column"], value_name="_y", collapsed=labels).select(
        "column", "_y", "n", "total_n", (F.col("before_n") + (F.col("n") - F.col("total_n")) / 2.0).alias("ry")))
    ry = labels.select("column", "_y", "ry")
    if ry.count() <= SMALL_TABLE:
        ry = F.broadcast(ry)                # its number of rows is known
    values = cut_lineage(lv.join(ry, ["column", "_y"]).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ry").alias("sy")))
    slices = values.repartitionByRange(max(1, -(-values.count() // SLICE_VALUES)), "column", "value").mapInArrow(
        _slice_moments, "column string, low double, k double, sy double, dd double, dy double")
    of_y = labels.groupBy("column").agg(F.first("total_n").alias("N"), F.sum(F.col("n") * F.col("ry") ** 2).alias("syy"))
    # one row per column and slice; "c": the slice's mean rank about the column's
    before = F.coalesce(F.sum("k").over(Window.partitionBy("column").orderBy("low").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0.0))
    g = (slices.withColumn("_before", before).join(of_y, "column")
         .withColumn("c", F.col("_before") + (F.col("k") - F.col("N")) / 2.0)
         .groupBy("column", "N", "syy").agg(F.sum(F.col("dd") + F.col("k") * F.col("c") ** 2).alias("sxx"),
                                            F.sum(F.col("dy") + F.col("c") * F.col("sy")).alias("sxy")))
    return g.select(F.col("column").alias("coluna"),
                    F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("corr"),
                    F.col("N").cast("long").alias("n"))


def _kendall_long(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Kendall tau-b against a 0/1 label: (C - D) / sqrt((P - Tx) * n0 * n1),
    C - D = #(x1 > x0) - #(x1 < x0), P = n(n-1)/2, Tx = tied pairs in x."""
    lv = long_values(df.where(_q(target).isNotNull()), columns, keep=[target])
    oc = ordered_counts(lv, "value", F.col(target), groups=["column"], value_name="_v")
    c0, c1 = F.col("c0").cast("double"), F.col("c1").cast("double")
    n = F.col("n").cast("double")
    g = oc.groupBy("column").agg(
        F.sum(c1 * F.col("before_0") - c0 * F.col("before_1")).alias("cd"),
        F.sum(n * (n - 1) / 2).alias("tx"),
        F.first("total_0").cast("double").alias("n0"), F.first("total_1").cast("double").alias("n1"))
    N = F.col("n0") + F.col("n1")
    pairs = N * (N - 1) / 2
    tau = F.try_divide(F.col("cd"), F.sqrt((pairs - F.col("tx")) * F.col("n0") * F.col("n1")))
    return g.select(F.col("column").alias("coluna"), tau.alias("corr"), N.cast("long").alias("n"))


def _kendall_any(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Kendall tau-b against any numeric label, by distributed inversion counting."""
    y = nan_to_null(_q(target).cast("double"))
    lv = long_values(df.withColumn(target, y).where(_q(target).isNotNull()), columns, keep=[target])
    points = lv.groupBy("column", F.col("value").alias("x"), _q(target).alias("y")).agg(F.count(F.lit(1)).alias("k"))
    return tau_b(points).select(F.col("column").alias("coluna"), F.col("tau").alias("corr"), "n")


def correlation_with_target(df: DataFrame, method: str = "pearson", top_n: int | None = None,
                            target: str = TARGET, columns: Sequence[str] | None = None) -> DataFrame:
    """``coluna, correlacao`` for every numeric column, ascending; null
    results dropped. ``top_n`` keeps the n lowest and the n highest (2n rows,
    duplicates kept when there are fewer than 2n columns)."""
    if target not in df.columns:
        raise KeyError(f"Column '{target}' not found in the DataFrame.")
    cols = list(columns) if columns else numeric_columns(df, exclude=[target])
    if method == "pearson":
        long = _pearson_long(df, cols, target)
    elif method == "spearman":
        long = _spearman_long(df, cols, target)
    elif method == "kendall":
        long = _kendall_long(df, cols, target) if _is_binary(df, target) else _kendall_any(df, cols, target)
    else:
        raise ValueError(f"Unknown method '{method}': use pearson, spearman or kendall.")
    res = (long.where(F.col("corr").isNotNull() & ~F.isnan("corr"))
               .select("coluna", F.col("corr").alias("correlacao")))
    if top_n is None:
        return res.orderBy("correlacao", "coluna")
    low = res.orderBy(F.col("correlacao").asc(), "coluna").limit(top_n).withColumn("_pos", F.lit(0))
    high = res.orderBy(F.col("correlacao").desc(), F.col("coluna").desc()).limit(top_n).withColumn("_pos", F.lit(1))
    return low.unionByName(high).orderBy("_pos", "correlacao", "coluna").drop("_pos")


def _is_binary(df: DataFrame, target: str) -> bool:
    return not df.where(_q(target).isNotNull() & ~_q(target).isin(0, 1)).limit(1).count()


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None,
                       max_null_share: float | None = 0.5) -> DataFrame:
    """pairwise-complete Pearson for every pair (lower triangle) in one
    scan: ``col_a, col_b, corr`` with col_a after col_b in column order.
    Without ``columns``, numeric columns with null share below
    ``max_null_share`` are used (B8), known from the same scan."""
    cols = numeric_columns(df) if columns is None else list(columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    return pair_correlations(df, cols, max_null_share if columns is None else None)


def scalar_udf(spark, fn):
    """Pandas UDF built at call time, after the package is shipped (a UDF
    captures the executors' Python path when it is first applied)."""
    ship_package(spark)
    return F.pandas_udf(fn, DoubleType())


def _t_p(r: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for rv, nv in zip(r, n):
        if rv is None or pd.isna(rv) or nv is None or nv < 3:
            out.append(float("nan"))
        elif abs(rv) >= 1.0:
            out.append(0.0)
        else:
            t = rv * ((nv - 2) / (1 - rv * rv)) ** 0.5
            out.append(tails.t_two_sided_p(t, nv - 2))
    return pd.Series(out, dtype="float64")


def point_biserial(df: DataFrame, target: str = TARGET, columns: Sequence[str] | None = None,
                   alpha: float = 0.05) -> DataFrame:
    """``coluna, correlacao, p_valor, significativo`` for numeric columns
    with more than 2 distinct values (over complete pairs), ascending r."""
    t_p = scalar_udf(df.sparkSession, _t_p)
    cols = list(columns) if columns else numeric_columns(df, exclude=[target])
    pear = _pearson_long(df, cols, target)
    lv = long_values(df.where(_q(target).isNotNull()), cols)
    distinct = lv.groupBy("column").agg(F.count_distinct("value").alias("_nd"))
    j = pear.join(distinct, pear.coluna == distinct.column).where(F.col("_nd") > 2)
    return (j.select("coluna", F.col("corr").alias("correlacao"),
                     t_p(F.col("corr"), F.col("n").cast("double")).alias("p_valor"))
             .withColumn("significativo", F.col("p_valor") < F.lit(alpha))
             .orderBy("correlacao", "coluna"))


def _chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([float("nan") if pd.isna(s) else tails.chi2_sf(float(s), int(d))
                      for s, d in zip(stat, dof)], dtype="float64")


def chi2_by_column(df: DataFrame, columns: Sequence[str], target: str = TARGET,
                   correction: bool = True) -> DataFrame:
    """Chi-square independence statistic of each column against the label, in
    one job over the long contingency table ``(column, value, label, n)``.
    Yates' correction applies when dof = 1 (scipy's default). Output:
    ``coluna, chi2, dof, n, k`` with k = min(rows, cols) - 1."""
    long = (df.select(_q(target).alias("_y"),
                      *[_q(c).cast("string").alias(c) for c in columns])
              .unpivot(["_y"], list(columns), "column", "value")
              .where(F.col("value").isNotNull() & F.col("_y").isNotNull()))
    cells = long.groupBy("column", "value", "_y").agg(F.count(F.lit(1)).alias("obs"))
    # Margins per column: cells has (#categories x #classes) rows per column.
    rt = cells.groupBy("column", "value").agg(F.sum("obs").alias("rt"))
    ct = cells.groupBy("column", "_y").agg(F.sum("obs").alias("ct"))
    dims = cells.groupBy("column").agg(
        F.sum("obs").alias("N"), F.count_distinct("value").alias("r"),
        F.count_distinct("_y").alias("c"))
    # ct: #columns x #classes rows, dims: one row per column (bounded, broadcast)
    full = (rt.join(F.broadcast(ct), "column").join(F.broadcast(dims), "column")
              .join(cells, ["column", "value", "_y"], "left")
              .withColumn("obs", F.coalesce("obs", F.lit(0)).cast("double")))
    exp = F.col("rt") * F.col("ct") / F.col("N")
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    diff = exp - F.col("obs")
    adj = F.when((dof == 1) & F.lit(correction),
                 F.col("obs") + F.signum(diff) * F.least(F.lit(0.5), F.abs(diff))).otherwise(F.col("obs"))
    term = (adj - exp) ** 2 / exp
    return (full.groupBy("column").agg(
                F.sum(term).alias("chi2"), F.first(dof).alias("dof"), F.first("N").alias("n"),
                F.first(F.least(F.col("r"), F.col("c")) - 1).alias("k"))
                .select(F.col("column").alias("coluna"),
                        F.when(F.col("dof") == 0, F.lit(0.0)).otherwise(F.col("chi2")).alias("chi2"),
                        "dof", "n", "k"))


def cramers_v(df: DataFrame, target: str = TARGET, columns: Sequence[str] | None = None) -> DataFrame:
    """``coluna, cramer_v`` = sqrt(chi2 / (n (min(r, c) - 1))), 0 when that
    is 0, rounded to 4; ascending."""
    from lendspark.operators.profile import string_columns
    cols = list(columns) if columns else string_columns(df, exclude=[target])
    chi = chi2_by_column(df, cols, target)
    v = F.when(F.col("k") > 0, F.sqrt(F.col("chi2") / (F.col("n") * F.col("k")))).otherwise(F.lit(0.0))
    return chi.select("coluna", round_half_even(v, 4).alias("cramer_v")).orderBy("cramer_v", "coluna")
