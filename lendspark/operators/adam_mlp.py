"""A multilayer perceptron trained by minibatch Adam on sharded data.

Rows are dealt to shards of about ``ROWS`` by a hash of their id. In every epoch each shard
goes through its minibatches, in an order of its own for the epoch, from the common weights and
Adam moments; then both are averaged over the shards, weighted by rows. With one shard this is
plain minibatch Adam. An epoch is one Spark job whose tasks can be run again; weights are
the only thing that passes the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.session import cut_lineage, ship_package

ROWS = 100_000            # rows of one shard
MERGE = 64                # shards averaged by one task
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


class Network:
    """Dense layers with ReLU and one logit; all weights in one vector."""

    def __init__(self, sizes: Sequence[int], weights: np.ndarray | None = None, seed: int = 42) -> None:
        self.sizes = [*sizes, 1]
        if weights is None:
            rng = np.random.default_rng(seed)
            weights = np.concatenate([np.concatenate((rng.normal(0, math.sqrt(2 / a), a * b), np.zeros(b)))
                                      for a, b in zip(self.sizes, self.sizes[1:])])
        self.w = np.array(weights, np.float64)

    def layers(self, flat: np.ndarray):
        at = 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            yield flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + (a + 1) * b]
            at += (a + 1) * b

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Inputs of every layer, and the logits last."""
        out = [x]
        last = len(self.sizes) - 2
        for k, (w, b) in enumerate(self.layers(self.w)):
            z = out[-1] @ w + b
            out.append(z if k == last else np.maximum(z, 0.0))
        return out

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, pos_weight: float) -> tuple[float, np.ndarray]:
        """Mean binary cross-entropy, positives weighted, and its gradient."""
        acts = self.forward(x)
        z = acts[-1][:, 0]
        weight = np.where(y == 1, pos_weight, 1.0)
        loss = float((weight * (np.logaddexp(0, z) - y * z)).mean())
        d = (weight * (_sigmoid(z) - y) / len(y))[:, None]
        grad = np.zeros_like(self.w)
        for (w, _), (gw, gb), a in reversed(list(zip(self.layers(self.w), self.layers(grad), acts[:-1]))):
            gw[...] = a.T @ d
            gb[...] = d.sum(0)
            d = (d @ w.T) * (a > 0)
        return loss, grad


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * z) + 1.0)


def adam_epoch(net: Network, m: np.ndarray, v: np.ndarray, step: int, x: np.ndarray, y: np.ndarray, batch: int,
               rate: float, pos_weight: float) -> float:
    """One pass over the rows in their order, in place; the sum of the rows' losses."""
    total = 0.0
    for s in range(0, len(y), batch):
        loss, g = net.loss_and_gradient(x[s:s + batch], y[s:s + batch], pos_weight)
        total += loss * len(y[s:s + batch])
        step += 1
        m += (1 - BETA1) * (g - m)
        v += (1 - BETA2) * (g * g - v)
        net.w -= rate * (m / (1 - BETA1 ** step)) / (np.sqrt(v / (1 - BETA2 ** step)) + EPSILON)
    return total


def _shard_epoch(sizes, state: np.ndarray, epoch: int, step: int, batch: int, rate: float, pos_weight: float):
    def run(table: pa.Table) -> pa.Table:
        x = np.stack(table.column("x").to_numpy())
        y, key = table.column("y").to_numpy().astype(np.float64), table.column("key").to_numpy()
        shard = table.column("shard")[0].as_py()
        order = np.argsort(key, kind="stable")
        order = order[np.random.default_rng([epoch, shard]).permutation(len(order))]
        w, m, v = np.split(state.copy(), 3)
        net = Network(sizes, w)
        loss = adam_epoch(net, m, v, step, x[order], y[order], batch, rate, pos_weight)
        out = np.concatenate((net.w, m, v)) * len(y)
        return pa.table({"shard": pa.array([shard], pa.int64()), "rows": pa.array([len(y)], pa.int64()),
                         "loss": pa.array([loss], pa.float64()), "state": pa.array([out.tobytes()], pa.binary())})
    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(s.as_buffer(), np.float64) for s in table.column("state"))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py() // MERGE], pa.int64()),
                     "rows": pa.array([sum(table.column("rows").to_pylist())], pa.int64()),
                     "loss": pa.array([sum(table.column("loss").to_pylist())], pa.float64()),
                     "state": pa.array([total.tobytes()], pa.binary())})


class AdamMlpModel:
    def __init__(self, net: Network, history: list[float]) -> None:
        self.net, self.history = net, history

    def score(self, df: DataFrame, features_col: str = "features", out: str = "score") -> DataFrame:
        """Add the probability of the positive class."""
        sizes, w = self.net.sizes[:-1], self.net.w
        ship_package(df.sparkSession)

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            return pd.Series(_sigmoid(Network(sizes, w).forward(np.stack(x.to_numpy()))[-1][:, 0]) if len(x) else [],
                             dtype="float64")
        return df.withColumn(out, probability(vector_to_array(features_col)))


def fit_adam_mlp(df: DataFrame, label: str = "TARGET", features_col: str = "features", id_col: str = "SK_ID_CURR",
                 hidden: Sequence[int] = (256, 128, 64), epochs: int = 30, batch: int = 1024, rate: float = 1e-3,
                 pos_weight: float = 1.0, seed: int = 42, shard_rows: int = ROWS) -> AdamMlpModel:
    """Train on the rows with a label; ``history`` has the mean training loss of every
    epoch, as met. Repeatable for unique ids. Raises ValueError without labelled rows."""
    ship_package(df.sparkSession)
    rows = df.where(F.col(label).isNotNull()).select(
        F.xxhash64(id_col, F.lit(seed)).alias("key"), F.col(label).cast("double").alias("y"),
        vector_to_array(features_col).alias("x"))
    n = rows.count()
    if not n:
        raise ValueError("No labelled rows to train on.")
    shards = -(-n // shard_rows)
    rows = cut_lineage(rows.withColumn("shard", F.pmod("key", F.lit(shards))))
    net = Network([len(rows.first()["x"]), *hidden], seed=seed)
    state, history, step = np.concatenate((net.w, np.zeros(2 * len(net.w)))), [], 0
    schema = "shard long, rows long, loss double, state binary"
    for epoch in range(epochs):
        out = rows.groupBy("shard").applyInArrow(
            _shard_epoch(net.sizes[:-1], state, epoch, step, batch, rate, pos_weight), schema)
        left = shards
        while left > 1:
            out = out.groupBy(F.floor(F.col("shard") / MERGE).alias("g")).applyInArrow(_add, schema)
            left = -(-left // MERGE)
        r = out.first()                                     # one row
        state = np.frombuffer(bytes(r["state"]), np.float64) / r["rows"]
        history.append(r["loss"] / r["rows"])
        step += max(1, -(-n // shards // batch))
    return AdamMlpModel(Network(net.sizes[:-1], state[:len(net.w)]), history)
