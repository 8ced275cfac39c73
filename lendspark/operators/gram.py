"""Pairwise-complete second moments of all pairs of columns in one scan.

A task keeps, for every pair of columns, the moments of the rows that have both: count,
means, squared deviations and the product of deviations. They come from matrix products
of the values, their squares and the presence mask of a batch, shifted by the batch's
first values, and are merged pair by pair with the parallel-variance combination. Blocks of
``TILE`` x ``TILE`` pairs travel as single cells, merged in two steps (``WAYS`` ways, then
all), so no task holds more than about ``WAYS`` blocks, or the tasks / ``WAYS``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.functions.nulls import nan_to_null
from lendspark.operators.profile import _q
from lendspark.session import cut_lineage, ship_package

TILE = 64
WAYS = 128
PARTS = ("n", "mx", "my", "xx", "yy", "xy")


def batch_moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Moments (6, columns of x, columns of y) of two blocks of columns, NaN missing."""
    def ready(v):
        mask = ~np.isnan(v)
        first = np.where(mask.any(0), v[mask.argmax(0), np.arange(v.shape[1])], 0.0)
        return mask.astype(np.float64), np.where(mask, v - first, 0.0), first
    (mx, vx, fx), (my, vy, fy) = ready(x), ready(y)
    n = mx.T @ my
    safe = np.maximum(n, 1.0)
    sx, sy = vx.T @ my, mx.T @ vy
    return np.stack([n, sx / safe + fx[:, None], sy / safe + fy[None, :],
                     np.maximum((vx * vx).T @ my - sx * sx / safe, 0.0),
                     np.maximum(mx.T @ (vy * vy) - sy * sy / safe, 0.0), vx.T @ vy - sx * sy / safe])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of the rows of both."""
    n = a[0] + b[0]
    safe = np.maximum(n, 1.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    w = a[0] * b[0] / safe
    share = b[0] / safe
    out = np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + w * dx * dx, a[4] + b[4] + w * dy * dy,
                    a[5] + b[5] + w * dx * dy])
    out = np.where(a[0] == 0, b, out)
    return np.where(b[0] == 0, a, out)


def _scan(n_cols: int):
    starts = range(0, n_cols, TILE)

    def run(batches):
        held, rows = {}, 0
        for b in batches:
            if not b.num_rows:
                continue
            rows += b.num_rows
            v = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns], axis=1)
            for i in starts:
                for j in starts:
                    if j <= i:
                        m = batch_moments(v[:, i:i + TILE], v[:, j:j + TILE])
                        held[i, j] = merge(held[i, j], m) if (i, j) in held else m
        way = TaskContext.get().partitionId() % WAYS
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in held], pa.int32()), pa.array([j for _, j in held], pa.int32()),
             pa.array([way] * len(held), pa.int32()), pa.array([rows] * len(held), pa.int64()),
             pa.array([m.tobytes() for m in held.values()], pa.binary())], names=["i", "j", "way", "rows", "block"])
    return run


def _merged(n_cols: int):
    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        shape = (len(PARTS), min(TILE, n_cols - i), min(TILE, n_cols - j))
        total = None
        for b in table.column("block"):
            m = np.frombuffer(b.as_buffer(), np.float64).reshape(shape)
            total = m if total is None else merge(total, m)
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
                         "rows": pa.array([sum(table.column("rows").to_pylist())], pa.int64()),
                         "block": pa.array([total.tobytes()], pa.binary())})
    return run


def _unpacked(n_cols: int):
    def run(batches):
        for b in batches:
            for i, j, rows, block in zip(*(c.to_pylist() for c in b.columns)):
                p, q = min(TILE, n_cols - i), min(TILE, n_cols - j)
                m = np.frombuffer(block, np.float64).reshape(len(PARTS), p, q)
                a, c = (v.ravel() for v in np.meshgrid(np.arange(i, i + p), np.arange(j, j + q), indexing="ij"))
                keep = c <= a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[keep], pa.int32()), pa.array(c[keep], pa.int32()),
                     pa.array(np.full(keep.sum(), rows), pa.int64())]
                    + [pa.array(v.ravel()[keep]) for v in m], names=["a", "b", "rows", *PARTS])
    return run


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rows, n, mx, my, xx, yy, xy) for the column numbers b <= a: rows of the table,
    rows that have both columns, and over these the means, the sums of squared deviations
    and of their products. Null and NaN are missing."""
    ship_package(df.sparkSession)
    k = len(columns)
    blocks = df.select(*[nan_to_null(_q(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(
        _scan(k), "i int, j int, way int, rows long, block binary")
    schema = "i int, j int, rows long, block binary"
    blocks = blocks.groupBy("i", "j", "way").applyInArrow(_merged(k), schema)
    blocks = blocks.groupBy("i", "j").applyInArrow(_merged(k), schema)
    return blocks.mapInArrow(_unpacked(k), "a int, b int, rows long, " + ", ".join(f"{p} double" for p in PARTS))


def pair_correlations(df: DataFrame, columns: Sequence[str], max_null_share: float | None = None) -> DataFrame:
    """(col_a, col_b, corr) of every pair, col_a after col_b: Pearson over the rows that have
    both (null where a column does not vary there). With ``max_null_share`` only columns
    whose share of nulls is below it, known from the same scan."""
    names = F.array(*[F.lit(c) for c in columns])
    m = cut_lineage(pair_moments(df, columns))       # one row a pair of columns
    out = m.where("a != b").select(
        F.element_at(names, F.col("a") + 1).alias("col_a"), F.element_at(names, F.col("b") + 1).alias("col_b"),
        F.when((F.col("xx") > 0) & (F.col("yy") > 0),
               F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).alias("corr"), "a", "b", "rows", "n")
    if max_null_share is not None:
        low = m.where("a = b").where(1 - F.col("n") / F.col("rows") < max_null_share).select(F.col("a").alias("k"))
        out = (out.join(low.withColumnRenamed("k", "a"), "a", "left_semi")
               .join(low.withColumnRenamed("k", "b"), "b", "left_semi"))
    return out.select("col_a", "col_b", "corr")
