"""Chart data: every chart's numbers computed on Spark as a
small result table; drawing is left to the caller.

Densities are kernel estimates on a fixed grid built from a fine histogram
per class (bins x grid join, both bounded by parameters), never from the raw
rows on one machine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.operators.ordered import exact_quantiles
from lendspark.operators.profile import (TARGET, _q, null_profile, rate_by_category, upper_trim,
                                         value_counts)

EXT_SOURCES = ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")


def class_balance(df: DataFrame, target: str = TARGET) -> DataFrame:
    """M1: class counts and percentages, by class index."""
    v = value_counts(df, target)
    return v.select(F.col("value").alias("classe"), "count",
                    (F.col("proportion") * 100).alias("pct")).orderBy("classe")


def box_stats(df: DataFrame, column: str, target: str = TARGET) -> DataFrame:
    """M3: quartiles, 1.5 IQR whiskers (most extreme values inside the
    fences) and outlier counts per class."""
    base = df.where(_q(column).isNotNull() & _q(target).isNotNull())
    q = exact_quantiles(base, column, [0.25, 0.5, 0.75], groups=[target], names=["q1", "median", "q3"])
    fences = q.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
              .withColumn("_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    x = _q(column).cast("double")
    # fences: one row per class
    agg = (base.join(F.broadcast(fences), target).groupBy(target).agg(
        F.min(F.when(x >= F.col("_lo"), x)).alias("whisker_low"),
        F.max(F.when(x <= F.col("_hi"), x)).alias("whisker_high"),
        F.count_if((x < F.col("_lo")) | (x > F.col("_hi"))).alias("n_outliers")))
    return q.join(agg, target).orderBy(target)


def equal_width_bin(x, lo, hi, bins: int):
    """1-based bin of x in ``bins`` equal-width bins over [lo, hi]; the last
    bin is closed (numpy / matplotlib convention); lo == hi -> bin 1."""
    b = F.floor((x - lo) / (hi - lo) * F.lit(bins)) + 1
    return F.when(hi == lo, F.lit(1)).otherwise(F.least(b, F.lit(bins))).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """M4: equal-width histogram over [min, max] (non-empty bins)."""
    x = _q(column).cast("double")
    rng = df.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))  # 1 row
    h = (df.where(x.isNotNull()).crossJoin(F.broadcast(rng))
           .withColumn("bin", equal_width_bin(x, F.col("_mn"), F.col("_mx"), bins))
           .groupBy("bin").agg(F.count(F.lit(1)).alias("count"),
                               F.first("_mn").alias("_mn"), F.first("_mx").alias("_mx")))
    width = (F.col("_mx") - F.col("_mn")) / bins
    return h.select("bin", (F.col("_mn") + (F.col("bin") - 1) * width).alias("left"),
                    (F.col("_mn") + F.col("bin") * width).alias("right"), "count").orderBy("bin")


def density_by_class(df: DataFrame, column: str, target: str = TARGET, trim_percentile: float | None = 99.0,
                     grid: int = 200, fine_bins: int = 1024) -> DataFrame:
    """M2: Gaussian kernel density per class, each normalised to its own
    class (``common_norm=False``), bandwidth by Scott's rule
    (sigma_c * n_c^(-1/5)), after an optional upper-percentile trim.
    Computed from a fine histogram: error is below half a fine bin."""
    base = df.where(_q(column).isNotNull() & _q(target).isNotNull())
    if trim_percentile is not None:
        base = upper_trim(base, column, trim_percentile)
    x = _q(column).cast("double")
    stats = base.groupBy(target).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(x).alias("_sd"))
    rng = base.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    step = (F.col("_mx") - F.col("_mn")) / fine_bins
    fine = (base.crossJoin(F.broadcast(rng))
                .withColumn("_b", F.least(F.floor((x - F.col("_mn")) / step), F.lit(fine_bins - 1)))
                .groupBy(target, "_b").agg(F.count(F.lit(1)).alias("_c"),
                                           F.first("_mn").alias("_mn"), F.first("_mx").alias("_mx")))
    centers = fine.withColumn("_x", F.col("_mn") + (F.col("_b") + 0.5) * step)
    pts = df.sparkSession.range(grid).withColumnRenamed("id", "_g")
    g = (pts.crossJoin(F.broadcast(rng))
            .select("_g", (F.col("_mn") + F.col("_g") * (F.col("_mx") - F.col("_mn")) / (grid - 1)).alias("x")))
    h = F.col("_sd") * F.pow(F.col("_n"), -0.2)
    # centers: <= classes x fine_bins rows; grid: `grid` rows
    j = centers.join(F.broadcast(stats), target).crossJoin(F.broadcast(g))
    k = F.exp(-0.5 * F.pow((F.col("x") - F.col("_x")) / h, 2)) / (h * math.sqrt(2 * math.pi))
    return (j.groupBy(target, "x").agg((F.sum(F.col("_c") * k) / F.first("_n")).alias("density"))
             .orderBy(target, "x"))


def class_medians_of(df: DataFrame, column: str, target: str = TARGET) -> DataFrame:
    """Median lines drawn on M2."""
    return exact_quantiles(df.where(_q(target).isNotNull()), column, [0.5], groups=[target], names=["median"])


def violin_stats(df: DataFrame, columns: Sequence[str], target: str = TARGET, grid: int = 100) -> DataFrame:
    """M5: per amount column and class, the density curve (M2) with the
    class quartiles (M3) alongside: ``column, TARGET, x, density, q1, median, q3``."""
    from lendspark.operators.profile import long_values
    parts = []
    for c in columns:
        parts.append(density_by_class(df, c, target, trim_percentile=None, grid=grid)
                     .withColumn("column", F.lit(c)))
    dens = parts[0]
    for p in parts[1:]:
        dens = dens.unionByName(p)
    # all columns' quartiles in one distributed job (groups = column x class)
    lv = long_values(df.where(_q(target).isNotNull()), columns, keep=[target])
    q = exact_quantiles(lv, "value", [0.25, 0.5, 0.75], groups=["column", target],
                        names=["q1", "median", "q3"])
    # q: one row per (column, class)
    return dens.join(F.broadcast(q), ["column", target], "left")


def category_rates(df: DataFrame, column: str, target: str = TARGET, min_samples: int = 0) -> DataFrame:
    """M7: rate per category with the base line."""
    return rate_by_category(df, column, target, min_samples)


def top_null_columns(df: DataFrame, n: int = 40) -> DataFrame:
    """The n columns with the highest null share."""
    return null_profile(df).limit(n)


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """M9: 2-D bin counts for a scatter of two columns (all rows, no sample)."""
    xc, yc = _q(x).cast("double"), _q(y).cast("double")
    rng = df.agg(F.min(xc).alias("_x0"), F.max(xc).alias("_x1"), F.min(yc).alias("_y0"), F.max(yc).alias("_y1"))
    bx = equal_width_bin(xc, F.col("_x0"), F.col("_x1"), bins)
    by = equal_width_bin(yc, F.col("_y0"), F.col("_y1"), bins)
    return (df.where(xc.isNotNull() & yc.isNotNull()).crossJoin(F.broadcast(rng))
              .groupBy(bx.alias("x_bin"), by.alias("y_bin")).agg(F.count(F.lit(1)).alias("count"))
              .orderBy("x_bin", "y_bin"))


def external_scores(df: DataFrame) -> list[str]:
    """Those of EXT_SOURCE_1/2/3 present in the frame."""
    return [c for c in EXT_SOURCES if c in df.columns]
