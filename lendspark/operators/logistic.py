"""Binary logistic regressions of many L2 terms and folds, fitted side by side.

Every fit is Spark's ``LogisticRegression`` (features scaled by the training rows' deviation
and centred, the same start, loss, L-BFGS and stopping rules), but the fits share their
passes: one look at a packed block of rows gives the losses and gradients of all fits that
train on it. The rows are packed once, whatever the number of fits; a cross-validation by
``CrossValidator`` caches each fold's rows and, inside each fit running at the time, a
scaled copy of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.operators.blocks import block_sums, each_block, java_doubles, make_blocks, matrix, pack, unpack
from lendspark.operators.evaluate import SLICE_ROWS, slice_sums
from lendspark.operators.lbfgs import minimize_all
from lendspark.session import cut_lineage

CHUNK = 2048              # rows multiplied at once
NO_FOLD = -1              # of a fit on all rows
FLUSH_ROWS = 100_000      # scored rows that a task holds
SCORED_AT_ONCE = 5        # draws whose scores are ranked in one shuffle


def fold_blocks(df: DataFrame, features_col: str, label_col: str, fold_col: str = "fold") -> DataFrame:
    """Packed rows, a block's rows of one fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            fold, y = b.column("fold").to_numpy(), b.column("y").to_numpy()
            x = matrix(b.column("x"))
            for f in np.unique(fold):
                yield pack(x[fold == f], y[fold == f], fold=int(f))
    return make_blocks(df.select(vector_to_array(features_col).alias("x"), F.col(label_col).cast("double").alias("y"),
                                 F.col(fold_col).alias("fold")), run)


class Moments:
    """Of the rows outside each held-out fold: their number, total weight, weight of class
    1, and the features' means and deviations (weighted, unbiased)."""

    def __init__(self, blocks: DataFrame, k: int, weights: Sequence[float]) -> None:
        def of_block(x, columns, found):
            w = np.where(columns[0] == 1, weights[1], weights[0])
            off = x - x[:, :1]                      # a constant feature deviates by 0 exactly
            mean = off @ w / w.sum()
            off -= mean[:, None]
            out = np.zeros((k, 4 + 2 * len(x)))
            out[found["fold"]] = [len(w), w.sum(), w @ w, w @ (columns[0] == 1), *(x[:, 0] + mean), *((off * off) @ w)]
            return out.ravel()

        self.k, self._folds = k, block_sums(blocks, of_block, lambda a, b: _merged(a.reshape(k, -1), b.reshape(k, -1)).ravel()).reshape(k, -1)
        self.rows = self._folds[:, 0]

    def without(self, fold: int):
        """(total weight, weight of class 1, means, deviations)."""
        kept = reduce(_merged, (self._folds[[f]] for f in range(self.k) if f != fold))[0]
        _, w, w2, hit = kept[:4]
        mean, m2 = np.split(kept[4:], 2)
        return w, hit, mean, np.sqrt(m2 / (w - w2 / w))


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of the union of two sets of rows (Chan, Golub & LeVeque), line by line."""
    out, d = a + b, (a.shape[1] - 4) // 2
    share = np.divide(b[:, 1], out[:, 1], out=np.zeros(len(a)), where=out[:, 1] > 0)[:, None]
    delta = b[:, 4:4 + d] - a[:, 4:4 + d]
    out[:, 4:4 + d] = np.where(a[:, 1:2] > 0, a[:, 4:4 + d] + delta * share, b[:, 4:4 + d])
    out[:, 4 + d:] += delta ** 2 * a[:, 1:2] * share
    return out


def fit_many(blocks: DataFrame, moments: Moments, weights: Sequence[float], fits: Sequence[tuple[int, float]],
             max_iter: int, tol: float) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) of each (held-out fold, L2 term)."""
    total, hit, mean, std = (np.array(v) for v in zip(*(moments.without(f) for f, _ in fits)))
    inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
    scaled_mean = mean * inverse
    held, regs = np.array([f for f, _ in fits]), np.array([r for _, r in fits])
    d = mean.shape[1]

    def raw(k, at: np.ndarray):
        return at[..., :d] * inverse[k], at[..., d] - (at[..., :d] * scaled_mean[k]).sum(-1)

    def losses(points):
        which = np.array(sorted(points))
        at = np.stack([points[k] for k in which])
        coef, off = raw(which, at)
        out_of = held[which]

        def of_block(x, columns, found):
            out = np.zeros((len(which), 2 + d))
            live = np.flatnonzero(out_of != found["fold"])
            a, b = coef[live], off[live][:, None]
            for s in range(0, len(columns[0]) if len(live) else 0, CHUNK):
                xs, t = np.ascontiguousarray(x[:, s:s + CHUNK]), columns[0][s:s + CHUNK]
                w = np.where(t == 1, weights[1], weights[0])
                m = a @ xs
                m += b
                e = np.abs(m)
                np.negative(e, e)
                np.exp(e, e)
                p = np.where(m >= 0, 1.0, e)
                e += 1.0
                p /= e
                p -= t
                p *= w
                np.log(e, e)                       # loss: log(1 + exp(m)) - t m
                e += np.maximum(m, 0.0)
                m *= t
                e -= m
                out[live, 0] += e @ w
                out[live, 1] += p.sum(1)
                out[live, 2:] += p @ xs.T
            return out.ravel()

        found = block_sums(blocks, of_block).reshape(len(which), 2 + d)
        answers = {}
        for row, k, x in zip(found, which, at):
            slope = np.append(row[2:] * inverse[k] - scaled_mean[k] * row[1], row[1]) / total[k]
            slope[:d] += regs[k] * x[:d]
            answers[int(k)] = float(row[0] / total[k] + 0.5 * regs[k] * (x[:d] @ x[:d])), slope
        return answers

    starts = [np.append(np.zeros(d), np.log(h / (w - h))) for h, w in zip(hit, total)]
    found = minimize_all(starts, losses, max_iter, tol)
    return [(c, float(b)) for c, b in (raw(k, x) for k, (x, _) in enumerate(found))]


def _scores(x: np.ndarray, models: Sequence[tuple[np.ndarray, float]]) -> np.ndarray:
    """One line a model; features are added in their order, so that equal rows score alike."""
    out = np.empty((len(models), x.shape[1]))
    for line, (coef, intercept) in zip(out, models):
        line[:] = 0.0
        for c, v in zip(coef, x):
            line += c * v
        line += intercept
    return out


def exact_aucs(blocks: DataFrame, models: dict[int, Sequence[tuple[np.ndarray, float]]], rows: np.ndarray) -> dict[int, list[float]]:
    """Exact AUC on each fold's rows of the models that left it out. Scores travel in
    packed slices of about ``SLICE_ROWS``, cut at scores of some rows; equal scores share
    a slice. What reaches the driver: those scores, and three numbers a slice."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in each_block(batches):
            x, _, found = unpack(block)
            if found["fold"] in models:
                some = np.ascontiguousarray(x[:, ::max(1, SLICE_ROWS // 64)])
                yield pa.RecordBatch.from_pydict({"fold": [found["fold"]], "scores": pa.array(
                    [_scores(some, models[found["fold"]]).tobytes()], pa.binary())})

    parts = {f: max(1, -(-int(rows[f]) // SLICE_ROWS)) for f in models}
    seen: dict[int, list[np.ndarray]] = {f: [] for f in models}
    if max(parts.values()) > 1:
        for r in blocks.mapInArrow(sample, "fold long, scores binary").collect():
            seen[r["fold"]].append(np.frombuffer(bytes(r["scores"])).reshape(len(models[r["fold"]]), -1))
    cuts = {f: [np.unique(np.quantile(s, np.arange(1, parts[f]) / parts[f], method="lower")) if parts[f] > 1 else np.zeros(0)
                for s in (np.concatenate(seen[f], axis=1) if seen[f] else [None] * len(models[f]))] for f in models}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {f: [] for f in models}

        def sent(f: int) -> Iterator[pa.RecordBatch]:
            scores, hit = np.concatenate([s for s, _ in held[f]], axis=1), np.concatenate([h for _, h in held[f]])
            held[f] = []
            for model, line in enumerate(scores):
                at = np.searchsorted(cuts[f][model], line, "right")
                out = {"fold": [], "model": [], "slice": [], "hits": [], "misses": []}
                order = np.argsort(at, kind="stable")
                for rows_of in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    out["fold"].append(f)
                    out["model"].append(model)
                    out["slice"].append(int(at[rows_of[0]]))
                    for name, side in (("hits", hit[rows_of]), ("misses", ~hit[rows_of])):
                        out[name].append(line[rows_of][side].tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=sliced)

        for _, block in each_block(batches):
            x, (y,), found = unpack(block)
            f = found["fold"]
            if f in models:
                held[f].append((_scores(x, models[f]), y == 1))
                if sum(len(h) for _, h in held[f]) >= FLUSH_ROWS:
                    yield from sent(f)
        for f in models:
            if held[f]:
                yield from sent(f)

    sliced = pa.schema([("fold", pa.int64()), ("model", pa.int64()), ("slice", pa.int64()), ("hits", pa.binary()), ("misses", pa.binary())])

    def rank(table: pa.Table) -> pa.Table:
        hits, misses = (np.concatenate([np.frombuffer(b.as_buffer()) for b in table.column(c)]) for c in ("hits", "misses"))
        _, n0, n1, above = slice_sums(np.concatenate((hits, misses)), np.arange(len(hits) + len(misses)) < len(hits))
        return pa.table({"fold": [table.column("fold")[0].as_py()], "model": [table.column("model")[0].as_py()],
                         "slice": [table.column("slice")[0].as_py()], "n0": [n0], "n1": [n1], "above": [above]})

    ranked = (blocks.mapInArrow(cut, "fold long, model long, slice long, hits binary, misses binary")
              .groupBy("fold", "model", "slice").applyInArrow(rank, "fold long, model long, slice long, n0 long, n1 long, above double"))
    slices = sorted(ranked.collect(), key=lambda r: r["slice"])             # one row a slice
    out = {}
    for f in models:
        out[f] = []
        for model in range(len(models[f])):
            above, n0, n1 = 0.0, 0, 0
            for r in slices:
                if r["fold"] == f and r["model"] == model:
                    above += r["above"] + float(r["n1"]) * n0
                    n0, n1 = n0 + r["n0"], n1 + r["n1"]
            out[f].append(above / n0 / n1 if n0 and n1 else float(n1 > 0))
    return out


def search_l2(folded: DataFrame, preprocessor: Pipeline, est: LogisticRegression, regs: Sequence[float], k: int,
              weights: Sequence[float]) -> tuple[list[float], PipelineModel]:
    """Mean exact AUC over the folds of each L2 term, and the pipeline refitted on all rows
    with the best (ties: the first). ``weights``: of a row of class 0 and of class 1."""
    spark, stages = folded.sparkSession, list(preprocessor.getStages())
    names = (est.getFeaturesCol(), est.getLabelCol())
    if stages:
        folded = cut_lineage(folded)                # read by every fold's stages
    every = None if stages else fold_blocks(folded, *names)
    moments = None if stages else Moments(every, k, weights)
    aucs = []
    # without stages all folds' fits share their passes; with stages each has rows of its own
    for folds in [[f] for f in range(k)] if stages else [list(range(k))]:
        blocks, m = every, moments
        if stages:
            fitted = Pipeline(stages=stages).fit(folded.where(F.col("fold") != folds[0]))
            blocks = fold_blocks(fitted.transform(folded), *names)
            m = Moments(blocks, k, weights)
        for f in folds:
            if not m.rows[f] or m.rows[f] == m.rows.sum():
                raise ValueError(f"The {'validation' if not m.rows[f] else 'training'} data at fold {f} is empty.")
        models = fit_many(blocks, m, weights, [(f, r) for f in folds for r in regs], est.getMaxIter(), est.getTol())
        of = {f: models[i * len(regs):(i + 1) * len(regs)] for i, f in enumerate(folds)}
        got: dict[int, list[float]] = {f: [] for f in folds}
        for s in range(0, len(regs), SCORED_AT_ONCE):
            for f, a in exact_aucs(blocks, {f: of[f][s:s + SCORED_AT_ONCE] for f in folds}, m.rows).items():
                got[f] += a
            spark._jvm.System.gc()                  # lets Spark delete the scores just ranked
        aucs += [got[f] for f in folds]
    mean = [float(np.mean(a)) for a in zip(*aucs)]
    best = max(range(len(regs)), key=lambda i: mean[i])
    fitted = Pipeline(stages=stages).fit(folded) if stages else None
    blocks = fold_blocks(fitted.transform(folded), *names) if stages else every
    m = Moments(blocks, k, weights) if stages else moments
    [(coef, intercept)] = fit_many(blocks, m, weights, [(NO_FOLD, regs[best])], est.getMaxIter(), est.getTol())
    java = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        est.uid, spark._jvm.org.apache.spark.ml.linalg.DenseVector(java_doubles(spark, coef)), intercept)
    model = est.copy({est.regParam: regs[best]})._copyValues(LogisticRegressionModel(java))
    return mean, PipelineModel(stages=[*(fitted.stages if fitted else []), model])
