"""Kendall's tau-b for any two numeric variables: distributed inversion counting.

Pairs of rows are compared by position, never enumerated. The distinct (x, y) pairs with
their row counts are dealt to blocks of the x order and of the y order by cumulative pair
counts; a value with more pairs than a block holds is a block of its own. Two pairs then
differ in

* the x block and the y block: counted on the table of block cells, which is the same
  problem on fewer points (solved in one task once it is small, by this again else);
* the y block alone: counted inside the x block;
* the x block alone, or neither: counted inside the y block, or the x block.

Inside a block the rank bits of y are gone through level by level with cumulative
weights (a Fenwick tree's sums, for all points at once in numpy).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.operators.ordered import ordered_counts
from lendspark.session import cut_lineage, ship_package

BLOCK = 200_000           # pairs of one block


def concordance(x: np.ndarray, y: np.ndarray, k: np.ndarray) -> tuple[float, float]:
    """Weights of the concordant and of the discordant pairs of weighted points."""
    if not len(x):
        return 0.0, 0.0
    order = np.argsort(x, kind="stable")
    x, k = x[order], k[order].astype(np.float64)
    values, y = np.unique(y[order], return_inverse=True)
    con = dis = 0.0
    for level in reversed(range(max(1, int(len(values) - 1).bit_length()))):
        group = y >> (level + 1)
        o = np.argsort(group, kind="stable")                   # inside a group: the order of x
        g, xs, w, high = group[o], x[o], k[o], (y[o] >> level) & 1 == 1
        new_group = np.concatenate(([True], g[1:] != g[:-1]))
        new_x = new_group | np.concatenate(([True], xs[1:] != xs[:-1]))
        here = np.arange(len(o))
        first = np.maximum.accumulate(np.where(new_group, here, 0))
        tie = np.maximum.accumulate(np.where(new_x, here, 0))  # points before it have a smaller x
        low_sum = np.concatenate(([0.0], np.cumsum(np.where(high, 0.0, w))))
        high_sum = np.concatenate(([0.0], np.cumsum(np.where(high, w, 0.0))))
        con += float((w * (low_sum[tie] - low_sum[first]))[high].sum())
        dis += float((w * (high_sum[tie] - high_sum[first]))[~high].sum())
    return con, dis


def _count(groups: tuple[str, ...], x: str, y: str):
    def run(table: pa.Table) -> pa.Table:
        con, dis = concordance(*(table.column(c).to_numpy() for c in (x, y, "k")))
        return pa.table({**{g: table.column(g).slice(0, 1) for g in groups}, "con": [con], "dis": [dis]})
    return run


def _blocks(points: DataFrame, axis: str, name: str, size: int) -> DataFrame:
    """(column, axis, name): block of each value of an axis, by cumulative point counts;
    odd numbers are values that are a block of their own."""
    counts = cut_lineage(points.groupBy("column", axis).agg(F.count(F.lit(1)).alias("n")))
    return ordered_counts(None, axis, groups=["column"], value_name=axis, collapsed=counts).select(
        "column", axis, (F.floor(F.col("before_n") / size) * 2 + (F.col("n") > size).cast("long")).alias(name))


def concordant_pairs(points: DataFrame, block: int | None = None) -> DataFrame:
    """(column, con, dis): weights of concordant and discordant pairs among the points
    (column, x, y, k), distinct in (column, x, y). Ties in x or y count in neither."""
    ship_package(points.sparkSession)
    points = cut_lineage(points)
    most = points.groupBy("column").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    size = block or max(BLOCK, 8 * int(most ** 0.5))
    schema = "column string, con double, dis double"
    if most <= 2 * size:
        return points.groupBy("column").applyInArrow(_count(("column",), "x", "y"), schema)
    placed = cut_lineage(points.join(_blocks(points, "x", "bx", size), ["column", "x"])
                         .join(_blocks(points, "y", "by", size), ["column", "y"]))
    inside = (placed.where("bx % 2 = 0").groupBy("column", "bx")
              .applyInArrow(_count(("column", "bx"), "x", "y"), "column string, bx long, con double, dis double"))
    beside = (placed.where("by % 2 = 0").groupBy("column", "by")
              .applyInArrow(_count(("column", "by"), "bx", "y"), "column string, by long, con double, dis double"))
    cells = placed.groupBy("column", F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y")).agg(
        F.sum("k").alias("k"))
    return (inside.drop("bx").unionByName(beside.drop("by")).unionByName(concordant_pairs(cells, block))
            .groupBy("column").agg(F.sum("con").alias("con"), F.sum("dis").alias("dis")))


def tau_b(points: DataFrame, block: int | None = None) -> DataFrame:
    """(column, tau, n) of the points (column, x, y, k)."""
    points = cut_lineage(points)

    def ties(axis: str) -> DataFrame:
        n = F.col("n").cast("double")
        return points.groupBy("column", axis).agg(F.sum("k").alias("n")).groupBy("column").agg(
            F.sum(n * (n - 1) / 2).alias(f"t_{axis}"), F.sum("n").alias(f"n_{axis}"))

    n = F.col("n_x").cast("double")
    pairs = n * (n - 1) / 2
    scale = F.sqrt((pairs - F.col("t_x")) * (pairs - F.col("t_y")))
    return (concordant_pairs(points, block).join(ties("x"), "column").join(ties("y"), "column")
            .select("column", F.try_divide(F.col("con") - F.col("dis"), scale).alias("tau"),
                    F.col("n_x").cast("long").alias("n")))
