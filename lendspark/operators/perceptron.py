"""Training of Spark's multilayer perceptron on packed rows.

The network, its starting weights, the loss (a mean over stacks of ``block_size`` rows, cut
partition by partition) and the optimizer are those of ``MultilayerPerceptronClassifier``;
the result is its model. Passes multiply whole blocks of rows, and a row that counts several
times is multiplied once with a weight instead of being written out several times.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.operators.blocks import block_sums, java_doubles, make_blocks, matrix, pack
from lendspark.operators.lbfgs import minimize_all

CHUNK = 2048              # rows multiplied at once


def stack_weights(copies: Iterator[tuple[np.ndarray, tuple]], size: int) -> Iterator[tuple[np.ndarray, tuple, int]]:
    """Weights of rows that stand ``copies`` times each in a row of stacks of ``size``: a
    copy weighs one over its stack's copies, and only the last stack can be short. Takes
    and gives batches (copies or weights, columns of the rows); with a batch come the
    stacks that end in it. Rows of an open stack wait for the next batch."""
    left, weight, rows = np.zeros(0, np.int64), np.zeros(0), None
    for more, columns in copies:
        rows = columns if rows is None else tuple(np.concatenate(p) for p in zip(rows, columns))
        left, weight = np.concatenate((left, more)), np.concatenate((weight, np.zeros(len(more))))
        ends = np.cumsum(left)
        stacks = int(ends[-1]) // size if len(ends) else 0
        inside = np.clip(stacks * size - (ends - left), 0, left)
        left, weight = left - inside, weight + inside / size
        done = int(np.searchsorted(ends, stacks * size, "right"))
        if done:
            yield weight[:done], tuple(c[:done] for c in rows), stacks
            left, weight, rows = left[done:], weight[done:], tuple(c[done:] for c in rows)
    if len(left):
        yield weight + left / left.sum(), rows, 1


def _packer(size: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        def rows():
            for b in batches:
                if b.num_rows:
                    label = b.column("y")
                    y = label.to_numpy(zero_copy_only=False)
                    if label.null_count or not np.isin(y, (0, 1)).all():
                        raise ValueError("Labels of the perceptron must be 0 or 1.")
                    yield np.where(y == 1, times, 1), (matrix(b.column("x")), y)
        for weight, (x, y), stacks in stack_weights(rows(), size):
            yield pack(x, y, weight, stacks=stacks)
    return run


def _layers(flat: np.ndarray, sizes: Sequence[int]):
    at = 0
    for a, b in zip(sizes, sizes[1:]):
        yield flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + (a + 1) * b]
        at += (a + 1) * b


def loss_and_gradient(w: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted cross-entropy of rows (the columns of ``x``) and its gradient, in one array."""
    out = np.zeros(1 + len(w))
    layers, grads = list(_layers(w, sizes)), list(_layers(out[1:], sizes))
    for s in range(0, len(y), CHUNK):
        acts, t, wt = [np.ascontiguousarray(x[:, s:s + CHUNK])], y[s:s + CHUNK] == 1, weight[s:s + CHUNK]
        for k, (m, b) in enumerate(layers):
            z = m.T @ acts[-1]
            z += b[:, None]
            if k < len(layers) - 1:
                np.negative(z, z)
                with np.errstate(over="ignore"):
                    np.exp(z, z)
                z += 1.0
                np.reciprocal(z, z)
            else:
                z -= z.max(0)
                np.exp(z, z)
                z /= z.sum(0)
            acts.append(z)
        p = acts.pop()
        with np.errstate(divide="ignore"):
            out[0] -= wt @ np.log(np.where(t, p[1], p[0]))
        d = p
        d[0] -= ~t
        d[1] -= t
        d *= wt
        for k in range(len(layers) - 1, -1, -1):
            a = acts[k]
            gw, gb = grads[k]
            gw += a @ d.T
            gb += d.sum(1)
            if k:
                d = layers[k][0] @ d
                d *= a
                d *= 1.0 - a
    return out


def fit_perceptron(df: DataFrame, mlp: MultilayerPerceptronClassifier,
                   times: int = 1) -> tuple[MultilayerPerceptronClassificationModel, list[float]]:
    """(model, loss of every iteration) of ``mlp`` (L-BFGS, two classes) on ``df`` with each
    positive row ``times`` times in a row."""
    sizes, size = mlp.getLayers(), mlp.getBlockSize()
    rows = df.select(vector_to_array(mlp.getFeaturesCol()).alias("x"), F.col(mlp.getLabelCol()).cast("double").alias("y"))
    blocks = make_blocks(rows, _packer(size, times))
    jvm = df.sparkSession._jvm
    widths = df.sparkSession.sparkContext._gateway.new_array(jvm.int, len(sizes))
    for k, n in enumerate(sizes):
        widths[k] = n
    start = np.array(jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(widths, True)
                     .model(mlp.getSeed()).weights().toArray())
    stacks = block_sums(blocks, lambda x, columns, found: np.array([float(found["stacks"])]))
    if stacks is None:
        raise ValueError("No rows to train on.")

    def losses(points):
        w = points[0]
        total = block_sums(blocks, lambda x, columns, _: loss_and_gradient(w, sizes, x, *columns)) / stacks[0]
        return {0: (float(total[0]), total[1:])}

    [(w, history)] = minimize_all([start], losses, mlp.getMaxIter(), mlp.getTol())
    java = jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(
        mlp.uid, jvm.org.apache.spark.ml.linalg.DenseVector(java_doubles(df.sparkSession, w)))
    java.set(java.layers(), widths)
    return mlp._copyValues(MultilayerPerceptronClassificationModel(java)), history
