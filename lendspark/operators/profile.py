"""Profiles and group statistics.

Design rules: one aggregate job covers all columns (moments, nulls, extremes);
exact medians and distinct counts come from the distributed ordered counts of
``(column, value)`` pairs, never from a single task; 1-row scalars are joined
with ``crossJoin(broadcast(...))`` (size 1 by construction).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendspark.functions.nulls import nan_to_null, round_half_even
from lendspark.functions.scalar import right_closed_bin
from lendspark.operators.ordered import collapse, exact_quantiles, quantile_parts
from lendspark.session import cut_lineage

TARGET = "TARGET"
AGG_CHUNK = 100  # expressions per aggregate, below codegen limits


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns (booleans are not numeric), in schema order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
                name: str = "column", value: str = "value") -> DataFrame:
    """Unpivot numeric columns to ``(keep..., column, value double)`` (an Expand,
    no shuffle); null and NaN values are dropped."""
    df2 = df.select(*[_q(k) for k in keep], *[nan_to_null(_q(c).cast("double")).alias(c) for c in columns])
    return (df2.unpivot(list(keep), list(columns), name, value)
               .where(F.col(value).isNotNull()))


def _sample_skew(g1: Column, n: Column, var: Column) -> Column:
    corr = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None)).when(var == 0, F.lit(0.0)).otherwise(corr)


def _sample_kurt(g2: Column, n: Column, var: Column) -> Column:
    corr = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n < 4, F.lit(None)).when(var == 0, F.lit(0.0)).otherwise(corr)


def _wide_to_long(df: DataFrame, columns: Sequence[str], per_col) -> DataFrame:
    """Run ``per_col(c) -> dict[name, agg Column]`` for every column in one scan and
    return one row per column."""
    structs = [F.struct(F.lit(c).alias("coluna"), *[v.alias(k) for k, v in per_col(c).items()]) for c in columns]
    chunks = [F.array(*structs[i:i + AGG_CHUNK]).alias(f"_a{i}") for i in range(0, len(structs), AGG_CHUNK)]
    row = df.agg(*chunks)
    return row.select(F.inline(F.flatten(F.array(*row.columns))))


def _with_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The unpivoted numeric columns as (column, value), nulls kept and NaN among them."""
    return (df.select(*[nan_to_null(_q(c).cast("double")).alias(c) for c in cols])
              .unpivot([], list(cols), "column", "value"))


def _long_stats(df: DataFrame, cols: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """One ``groupBy(column)`` pass (nulls kept, so row counts are right) for ``aggs``, a
    fixed number of expressions whatever the column count."""
    return _with_nulls(df, cols).groupBy("column").agg(*[c.alias(k) for k, c in aggs.items()])


def _long_pass(df: DataFrame, cols: Sequence[str], aggs: dict[str, Column]):
    """The unpivoted numeric columns collapsed to (column, value, n), for everything
    ordered, and :func:`_long_stats` of ``aggs``."""
    return collapse(_with_nulls(df, cols), "value", groups=["column"]), _long_stats(df, cols, aggs)


# Fixed values of column_medians: rank error of a column's first look (a share of its
# rows), and the share on either side of the median that is then looked at exactly
MEDIAN_LOOK = 1_000
MEDIAN_SIDE = 0.005


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median of every numeric column that has a value (nulls and NaN left out).

    A first pass brackets each median between two values a little on either side of it
    (``percentile_approx``, whose rank error is bounded). The second counts every row, but
    values outside the bracket count as one value below and one above it, so that only
    those about the median are ordered. A median outside its bracket is looked up among
    all of the column's values."""
    wide = df.select(*[nan_to_null(_q(c).cast("double")).alias(c) for c in cols])
    sides = [0.5 - MEDIAN_SIDE, 0.5 + MEDIAN_SIDE]
    looks = _wide_to_long(wide, cols, lambda c: {"b": F.percentile_approx(_q(c), sides, MEDIAN_LOOK)})
    bracket = {r["coluna"]: r["b"] for r in looks.collect() if r["b"] is not None}      # one row per column

    def medians(columns: Sequence[str], clamp) -> dict[str, float]:
        if not columns:
            return {}
        values = wide.select(*[clamp(c).alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
        rows = exact_quantiles(None, "value", [0.5], groups=["column"], names=["m"],
                               collapsed=collapse(values, "value", groups=["column"])).collect()
        return {r["column"]: r["m"] for r in rows}      # one row per column

    def clamped(c: str) -> Column:
        lo, hi = bracket[c]
        return (F.when(_q(c) < lo, F.lit(float("-inf"))).when(_q(c) > hi, F.lit(float("inf"))).otherwise(_q(c)))

    found = medians([c for c in cols if c in bracket], clamped)
    missed = [c for c, m in found.items() if m is None or not bracket[c][0] <= m <= bracket[c][1]]
    return {**found, **medians(missed, _q)}


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True,
                    rsd: float = 0.01) -> DataFrame:
    """Non-null distinct values per column. Exact: one shuffle of the
    unpivoted ``(column, value)`` pairs (partial aggregation map-side).
    ``exact=False`` uses HyperLogLog++ (``approx_count_distinct``, relative
    error ``rsd``), no shuffle of values at all."""
    cols = list(columns) if columns else df.columns
    if not exact:
        def per_col(c):
            return {"n_unicos": F.approx_count_distinct(_q(c), rsd)}
        return _wide_to_long(df, cols, per_col)
    lv = (df.select(*[_q(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "coluna", "value").where(F.col("value").isNotNull()))
    return (lv.distinct().groupBy("coluna")
              .agg(F.count(F.lit(1)).alias("n_unicos")))


def numeric_profile(df: DataFrame, target: str = TARGET, decimals: int = 4) -> DataFrame:
    """``coluna, media, mediana, desvio_padrao, minimo, maximo, skewness,
    kurtosis, pct_nulos, n_unicos`` per numeric column except the label.
    Two passes: moments, and the distinct values with their counts."""
    cols = numeric_columns(df, exclude=[target])
    if not cols:
        raise ValueError("No numeric columns to profile.")
    x = F.col("value")
    values, moments = _long_pass(df, cols, {
        "_n": F.count(x).cast("double"), "_rows": F.count(F.lit(1)), "media": F.avg(x),
        "desvio_padrao": F.stddev_samp(x), "minimo": F.min(x), "maximo": F.max(x),
        "_g1": F.skewness(x), "_g2": F.kurtosis(x), "_var": F.var_pop(x)})
    qp = quantile_parts(None, "value", [0.5], groups=["column"], collapsed=values)
    med = qp.select("column", F.col("_D").alias("n_unicos"),
                    ((F.col("_lo0") + F.col("_hi0")) / 2).alias("mediana"))
    j = moments.join(med, "column", "left")
    n, var = F.col("_n"), F.col("_var")
    r = lambda c: round_half_even(c, decimals)
    return j.select(
        F.col("column").alias("coluna"), r(F.col("media")).alias("media"),
        r(F.col("mediana")).alias("mediana"),
        r(F.col("desvio_padrao")).alias("desvio_padrao"), r(F.col("minimo")).alias("minimo"),
        r(F.col("maximo")).alias("maximo"),
        r(_sample_skew(F.col("_g1"), n, var)).alias("skewness"),
        r(_sample_kurt(F.col("_g2"), n, var)).alias("kurtosis"),
        round_half_even((F.col("_rows") - F.col("_n")) / F.col("_rows") * 100, 2).alias("pct_nulos"),
        F.coalesce(F.col("n_unicos"), F.lit(0)).cast("long").alias("n_unicos"))


def _missing(df: DataFrame, c: str) -> Column:
    """Null, or NaN in a floating-point column."""
    x = _q(c)
    return x.isNull() | F.isnan(x) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) \
        else x.isNull()


def null_profile(df: DataFrame) -> DataFrame:
    """``coluna, n_nulos, pct_nulos, dtype`` for columns with nulls,
    highest share first (ties by column name)."""
    fields = df.schema.fields
    types = {f.name: f.dataType.simpleString() for f in fields}

    def per_col(c):
        return {"n_nulos": F.count_if(_missing(df, c)), "_rows": F.count(F.lit(1)),
                "dtype": F.lit(types[c])}

    long = _wide_to_long(df, [f.name for f in fields], per_col)
    return (long.where(F.col("n_nulos") > 0)
                .select("coluna", F.col("n_nulos").cast("long").alias("n_nulos"),
                        round_half_even(F.col("n_nulos") / F.col("_rows") * 100, 2).alias("pct_nulos"),
                        "dtype")
                .orderBy(F.col("pct_nulos").desc(), "coluna"))


def null_summary(profile: DataFrame, total_columns: int, high: float = 50.0) -> DataFrame:
    """E3/E4 summary row: columns with nulls, share, columns above ``high`` %,
    mean of the per-column null shares over all columns."""
    return profile.agg(
        F.count(F.lit(1)).alias("columns_with_nulls"),
        F.lit(total_columns).alias("total_columns"),
        round_half_even(F.count(F.lit(1)) / F.lit(total_columns) * 100, 1).alias("pct_columns_with_nulls"),
        F.count_if(F.col("pct_nulos") > high).alias("columns_over_high"),
        (F.coalesce(F.sum("pct_nulos"), F.lit(0.0)) / F.lit(total_columns)).alias("mean_null_pct"))


def null_share_gate(df: DataFrame, max_mean_pct: float = 5.0) -> DataFrame:
    """Mean of per-column null shares (%) and whether it exceeds the limit
    (the ETL warns, it does not stop)."""
    cols = [f.name for f in df.schema.fields]
    shares = [F.avg(_missing(df, c).cast("double")) for c in cols]
    mean = sum(shares[1:], shares[0]) / F.lit(len(cols)) * 100
    return df.agg(mean.alias("mean_null_pct")).withColumn(
        "warn", F.col("mean_null_pct") > F.lit(max_mean_pct))


def columns_below_null_share(df: DataFrame, max_share: float = 0.5) -> list[str]:
    """Names of columns whose null share is below ``max_share`` (one job;
    the result is one number per column)."""
    cols = [f.name for f in df.schema.fields]
    row = df.agg(*[F.avg(_missing(df, c).cast("double")).alias(f"_{i}")
                   for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"_{i}"] is not None and row[f"_{i}"] < max_share]


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """E5: count, mean, std, min, exact quartiles, max, one row per column
    (two passes, like :func:`numeric_profile`)."""
    cols = list(columns) if columns else numeric_columns(df)
    x = F.col("value")
    values, base = _long_pass(df, cols, {
        "count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x),
        "min": F.min(x), "max": F.max(x)})
    q = exact_quantiles(None, "value", [0.25, 0.5, 0.75], groups=["column"],
                        names=["q25", "q50", "q75"], collapsed=values)
    j = base.join(q, "column", "left")
    return j.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of 2nd+ occurrences of rows (or of a key)."""
    cols = list(columns) if columns else df.columns
    return (df.groupBy(*[_q(c) for c in cols]).count()
              .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates")))


def dtype_counts(df: DataFrame) -> DataFrame:
    """Column count per type (schema only, no job over data)."""
    counts: dict[str, int] = {}
    for f in df.schema.fields:
        counts[f.dataType.simpleString()] = counts.get(f.dataType.simpleString(), 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "dtype string, n_columns long")


def base_rate(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Label mean over non-null labels."""
    return df.agg(F.avg(_q(target).cast("double")).alias("base_rate"),
                  F.count(_q(target)).alias("n"))


def count_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Named ``count_if`` checks in one pass (null counts, sentinel counts)."""
    return df.agg(*[F.count_if(c).cast("long").alias(k) for k, c in checks.items()])


# ---------------------------------------------------------------------------
# Keyed statistics against the label
# ---------------------------------------------------------------------------

def _counts_by(df: DataFrame, column: str, target: str) -> DataFrame:
    """(categoria, n, s): labelled rows and sum of the label per category, the null
    one included. Kept, so that the overall mean comes from it and not from a
    second pass over the rows."""
    return cut_lineage(df.groupBy(_q(column).alias("categoria")).agg(
        F.count(_q(target)).alias("n"), F.coalesce(F.sum(_q(target)), F.lit(0)).cast("double").alias("s")))


def default_rate_by_group(df: DataFrame, column: str, target: str = TARGET,
                          min_samples: int = 30) -> DataFrame:
    """``categoria, n_clientes, n_inadimplentes, taxa_inadimplencia_pct,
    diferenca_media_pct``; groups with fewer than ``min_samples`` labelled rows
    and the null category are dropped; highest rate first."""
    for c in (target, column):
        if c not in df.columns:
            raise KeyError(f"Column '{c}' not found in the DataFrame.")
    counts = _counts_by(df, column, target)
    overall = counts.agg((F.sum("s") / F.sum("n") * 100).alias("_overall"))       # one row
    groups = counts.where("categoria IS NOT NULL").select(
        "categoria", F.col("n").alias("n_clientes"), F.col("s").cast("long").alias("n_inadimplentes"))
    rate = round_half_even(F.try_divide(F.col("n_inadimplentes") * 100.0, F.col("n_clientes")), 2)
    out = (groups.crossJoin(F.broadcast(overall))
                 .withColumn("taxa_inadimplencia_pct", rate)
                 .withColumn("diferenca_media_pct",
                             round_half_even(F.col("taxa_inadimplencia_pct") - F.col("_overall"), 2))
                 .where(F.col("n_clientes") >= min_samples)
                 .drop("_overall"))
    return out.orderBy(F.col("taxa_inadimplencia_pct").desc_nulls_last(), "categoria")


def rate_by_category(df: DataFrame, column: str, target: str = TARGET,
                     min_samples: int = 0) -> DataFrame:
    """Unrounded label rate and count per category, lowest first, with
    the overall mean alongside (for the base line of the chart)."""
    counts = _counts_by(df, column, target)
    overall = counts.agg((F.sum("s") / F.sum("n")).alias("media_geral"))          # one row
    g = counts.where("categoria IS NOT NULL").select(
        "categoria", F.try_divide(F.col("s"), F.col("n")).alias("taxa"), "n")
    return (g.where(F.col("n") >= min_samples).crossJoin(F.broadcast(overall))
             .orderBy("taxa", "categoria"))


def class_medians(df: DataFrame, columns: Sequence[str], target: str = TARGET) -> DataFrame:
    """Exact median of each column per class, long by column with one
    median column per class (0 and 1)."""
    lv = long_values(df.where(_q(target).isNotNull()), columns, keep=[target])
    q = exact_quantiles(lv, "value", [0.5], groups=["column", target], names=["median"])
    return (q.groupBy("column").agg(
        F.first(F.when(_q(target) == 0, F.col("median")), ignorenulls=True).alias("median_0"),
        F.first(F.when(_q(target) == 1, F.col("median")), ignorenulls=True).alias("median_1")))


def rate_by_bin(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str] | None = None,
                target: str = TARGET) -> DataFrame:
    """Label rate (%) per right-closed bin of a numeric column."""
    b = right_closed_bin(_q(column), edges, labels)
    order = right_closed_bin(_q(column), edges, None)
    return (df.select(b.alias("bin"), order.alias("bin_index"), _q(target).alias("_t"))
              .where(F.col("bin").isNotNull())
              .groupBy("bin", "bin_index")
              .agg((F.avg(F.col("_t").cast("double")) * 100).alias("taxa_pct"),
                   F.count("_t").alias("n"))
              .orderBy("bin_index"))


def rate_by_segment(df: DataFrame, segment: str, target: str = TARGET, decimals: int = 4) -> DataFrame:
    """Count, positives and rounded rate per segment (cluster, flag)."""
    return (df.groupBy(_q(segment).alias("segment"))
              .agg(F.count(F.lit(1)).alias("n"),
                   F.coalesce(F.sum(_q(target)), F.lit(0)).cast("long").alias("positives"),
                   round_half_even(F.avg(_q(target).cast("double")), decimals).alias("rate"))
              .orderBy("segment"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Absolute and normalised counts (nulls excluded), largest first."""
    g = df.where(_q(column).isNotNull()).groupBy(_q(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    total = g.agg(F.sum("count").alias("_total"))
    return (g.crossJoin(F.broadcast(total))
             .select("value", "count", (F.col("count") / F.col("_total")).alias("proportion"))
             .orderBy(F.col("count").desc(), "value"))


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """Cross-tab in long form ``(row, col, n)``; null pairs dropped."""
    return (df.where(_q(row).isNotNull() & _q(col).isNotNull())
              .groupBy(_q(row).alias("row_value"), _q(col).alias("col_value"))
              .agg(F.count(F.lit(1)).alias("n")))


def upper_trim(df: DataFrame, column: str, percentile: float = 99.0, exact: bool = True) -> DataFrame:
    """Keep rows with ``column <= p-th percentile`` (threshold is a 1-row
    broadcast)."""
    if exact:
        thr = exact_quantiles(df, column, [percentile / 100.0], names=["_thr"])
    else:
        thr = df.agg(F.percentile_approx(_q(column), percentile / 100.0, 10000).alias("_thr"))
    return (df.crossJoin(F.broadcast(thr)).where(_q(column) <= F.col("_thr")).drop("_thr"))
