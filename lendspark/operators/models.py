"""Classifiers, cross-validation and model search.

The reference's scikit-learn / boosting / torch models map onto Spark ML
estimators trained on the cluster. Class balance uses a weight column
n / (2 n_c) computed from two class counts (broadcast as a 1-row table).
Cross-validation fits the whole pipeline per fold (no leakage); the folds'
predictions are evaluated together in one job, grouped by fold.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.operators import evaluate as ev
from lendspark.operators.logistic import search_l2
from lendspark.operators.perceptron import fit_perceptron
from lendspark.operators.prep import RANDOM_STATE, stratified_folds, stratified_split
from lendspark.session import cut_lineage, cut_spread

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for the same results)
# ---------------------------------------------------------------------------
AVAILABLE_MODELS = ["logistic_regression", "random_forest", "lightgbm", "xgboost"]
N_ESTIMATORS_RF = 200
MAX_ITER_LR = 1000
TOL_LR = 1e-4  # the classifier library's default stopping tolerance (Spark's is 1e-6)
MLP_LAYERS = (256, 128, 64)
MLP_POS_WEIGHT = 11
MLP_EPOCHS = 50
MLP_BATCH = 1024
MLP_LR = 1e-3
SEARCH_DRAWS = 20
SEARCH_BUDGET_S = 120

WEIGHT_COL = "class_weight"


class ModelTrainingError(Exception):
    """A fold (or the final fit) failed; wraps the original error."""


def get_model(name: str, features_col: str = "features", label_col: str = "TARGET",
              weight_col: str | None = WEIGHT_COL, **kwargs):
    """Estimator by name with the reference's defaults; ``kwargs`` (Spark
    param names) override them. ``lightgbm`` and ``xgboost`` are gradient
    boosted trees (``GBTClassifier``); results are not numerically equal to
    those libraries."""
    if name not in AVAILABLE_MODELS:
        raise ValueError(f"Model '{name}' not available. Valid options: {AVAILABLE_MODELS}")
    common = dict(featuresCol=features_col, labelCol=label_col)
    if name == "logistic_regression":
        params = dict(common, maxIter=MAX_ITER_LR, tol=TOL_LR)
        if weight_col:
            params["weightCol"] = weight_col
        params.update(kwargs)
        return LogisticRegression(**params)
    if name == "random_forest":
        params = dict(common, numTrees=N_ESTIMATORS_RF, seed=RANDOM_STATE)
        if weight_col:
            params["weightCol"] = weight_col
        params.update(kwargs)
        return RandomForestClassifier(**params)
    params = dict(common, seed=RANDOM_STATE)
    if weight_col:
        params["weightCol"] = weight_col
    params.update(kwargs)
    return GBTClassifier(**params)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """One row: n, n0, n1."""
    return df.agg(F.count(F.col(label)).alias("_n"),
                  F.count_if(F.col(label) == 0).alias("_n0"),
                  F.count_if(F.col(label) == 1).alias("_n1"))


def add_balanced_weights(df: DataFrame, label: str, out: str = WEIGHT_COL,
                         scale_pos_weight: float | None = None) -> DataFrame:
    """Weight n / (2 n_c) per row (or 1 / ``scale_pos_weight`` for the
    xgboost flavour: negatives 1, positives ``scale_pos_weight``)."""
    if scale_pos_weight is not None:
        return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(scale_pos_weight)))
                             .otherwise(F.lit(1.0)))
    # three numbers, computed once: every later pass over the weighted rows
    # (each stage fit) then carries two literals instead of re-aggregating
    r = class_counts(df, label).first()
    n, n0, n1 = float(r["_n"]), float(r["_n0"]), float(r["_n1"])
    w1 = F.lit(n / (2.0 * n1)) if n1 else F.lit(None).cast("double")
    w0 = F.lit(n / (2.0 * n0)) if n0 else F.lit(None).cast("double")
    return df.withColumn(out, F.when(F.col(label) == 1, w1).otherwise(w0))


def positive_weight(df: DataFrame, label: str) -> float:
    """n_neg / n_pos (the notebook's ``scale_pos_weight``)."""
    r = class_counts(df, label).first()
    return float(r["_n0"]) / float(r["_n1"]) if r["_n1"] else 1.0


def with_probability(df: DataFrame, prob_col: str = "probability", out: str = "score") -> DataFrame:
    """Positive-class probability as a double column."""
    return df.withColumn(out, vector_to_array(prob_col)[1])


def cross_validate(df: DataFrame, preprocessor: Pipeline, model_name: str = "logistic_regression",
                   label: str = "TARGET", id_col: str = "SK_ID_CURR", k: int = 5,
                   seed: int = RANDOM_STATE, parallelism: int | None = None, model_kwargs: dict | None = None,
                   runs_path: str | None = None, checkpoint: bool = True) -> tuple[DataFrame, DataFrame]:
    """Stratified k-fold CV. Per fold the full pipeline (preprocessing +
    classifier, class weights from the fold's training rows) is fitted on the
    other folds and scores its own fold. Returns (per-fold metrics, K4
    aggregate). Errors are wrapped in :class:`ModelTrainingError`."""
    folded = stratified_folds(df, label, id_col, k=k, seed=seed)
    if checkpoint:
        folded = cut_lineage(folded)  # every fold re-reads it: cut lineage once

    def run_fold(i: int) -> DataFrame:
        train = add_balanced_weights(folded.where(F.col("fold") != i), label)
        val = folded.where(F.col("fold") == i)
        est = get_model(model_name, label_col=label, **(model_kwargs or {}))
        fitted = Pipeline(stages=list(preprocessor.getStages()) + [est]).fit(train)
        return with_probability(fitted.transform(val)).select(
            F.col("fold"), F.col(label).alias("label"), "score")

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism or k)) as pool:
            scored = list(pool.map(run_fold, range(k)))
    except Exception as exc:  # noqa: BLE001 - wrap any training failure
        raise ModelTrainingError(f"Error training model '{model_name}': {exc}") from exc
    allp = scored[0]
    for s in scored[1:]:
        allp = allp.unionByName(s)
    allp = cut_lineage(allp)       # (fold, label, score): the metrics' passes must not score again
    per_fold = cut_lineage(ev.evaluate(allp, "label", "score", groups=["fold"]))     # k rows
    summary = ev.aggregate_folds(per_fold)
    if runs_path:
        from lendspark.sources.io import log_run
        row = summary.first().asDict()
        log_run(df.sparkSession, runs_path, "cross_validation",
                params={"model_name": model_name, "cv_folds": k},
                metrics={m: row[m] for m in ("auc_roc_mean", "auc_roc_std", "gini_mean",
                                             "ks_stat_mean", "f1_mean")})
    return per_fold, summary


def draw_params(space: dict, n_iter: int = SEARCH_DRAWS, seed: int = RANDOM_STATE) -> list[dict]:
    """L13 draws: a list is sampled uniformly; ``("loguniform", lo, hi)`` and
    ``("uniform", lo, hi)`` are continuous; ``("randint", lo, hi)`` integer."""
    rng = random.Random(seed)
    draws = []
    for _ in range(n_iter):
        d = {}
        for k in sorted(space):
            v = space[k]
            if isinstance(v, tuple) and v and v[0] == "loguniform":
                d[k] = math.exp(rng.uniform(math.log(v[1]), math.log(v[2])))
            elif isinstance(v, tuple) and v and v[0] == "uniform":
                d[k] = rng.uniform(v[1], v[2])
            elif isinstance(v, tuple) and v and v[0] == "randint":
                d[k] = rng.randint(v[1], v[2] - 1)
            else:
                d[k] = rng.choice(list(v))
        draws.append(d)
    return draws


def random_search(df: DataFrame, preprocessor: Pipeline, param_space: dict,
                  model_name: str = "logistic_regression", label: str = "TARGET",
                  id_col: str = "SK_ID_CURR", n_iter: int = SEARCH_DRAWS, k: int = 5,
                  seed: int = RANDOM_STATE, parallelism: int = 2):
    """Seeded random search scored by exact AUC on the stratified folds; returns
    (best params, best mean AUC, refitted PipelineModel). Class weights are those of
    all rows: stratified folds have the same class shares up to one row. Draws of a
    logistic regression's L2 term share their passes (:mod:`lendspark.operators.logistic`);
    anything else goes through Spark's ``CrossValidator``, ``parallelism`` fits at a time."""
    est = get_model(model_name, label_col=label)
    pipe = Pipeline(stages=list(preprocessor.getStages()) + [est])
    draws = draw_params(param_space, n_iter, seed)
    if model_name == "logistic_regression" and set(param_space) == {"regParam"}:
        r = class_counts(df, label).first()
        n, n0, n1 = float(r["_n"]), float(r["_n0"]), float(r["_n1"])
        if n == n0 + n1 and min(n0, n1) > 1:         # both classes in every fold's training rows
            aucs, model = search_l2(stratified_folds(df, label, id_col, k=k, seed=seed), preprocessor, est,
                                    [d["regParam"] for d in draws], k, (n / (2.0 * n0), n / (2.0 * n1)))
            best = max(range(len(draws)), key=lambda i: aucs[i])
            return draws[best], aucs[best], model
    maps = [{est.getParam(p): v for p, v in d.items()} for d in draws]
    folded = add_balanced_weights(stratified_folds(df, label, id_col, k=k, seed=seed), label)
    folded = cut_lineage(folded)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps,
                        evaluator=ev.ExactAUC(label),
                        foldCol="fold", numFolds=k, parallelism=parallelism, seed=seed)
    cvm = cv.fit(folded)
    best = max(range(len(draws)), key=lambda i: cvm.avgMetrics[i])
    return draws[best], float(cvm.avgMetrics[best]), cvm.bestModel


def fit_final(df: DataFrame, preprocessor: Pipeline, model_name: str = "logistic_regression",
              label: str = "TARGET", model_kwargs: dict | None = None,
              checkpoint: bool = True) -> PipelineModel:
    """Refit on all rows (class weights from all rows). Every stage's
    fit is a pass over the input, so it is materialized once first."""
    est = get_model(model_name, label_col=label, **(model_kwargs or {}))
    train = add_balanced_weights(df, label)
    if checkpoint:
        train = cut_lineage(train)
    try:
        return Pipeline(stages=list(preprocessor.getStages()) + [est]).fit(train)
    except Exception as exc:  # noqa: BLE001
        raise ModelTrainingError(f"Error training model '{model_name}': {exc}") from exc


def budgeted_search(df: DataFrame, preprocessor: Pipeline, spaces: dict[str, dict],
                    label: str = "TARGET", id_col: str = "SK_ID_CURR",
                    time_budget_s: float | None = SEARCH_BUDGET_S, seed: int = RANDOM_STATE,
                    max_trials: int | None = None):
    """Try (model, params) candidates round-robin until the time budget
    ends or ``max_trials`` are done (one of them must be given; only the second
    makes the work repeatable); each is fitted on an 80 % stratified split and scored by exact AUC
    on the other 20 %. Returns (best model name, params, AUC, PipelineModel)."""
    split = cut_spread(stratified_split(df, label, id_col, 0.2, seed), df.count())
    train = add_balanced_weights(split.where(F.col("split") == "train"), label)
    val = split.where(F.col("split") == "test")
    draws = {m: draw_params(s, SEARCH_DRAWS, seed) for m, s in spaces.items()}
    if time_budget_s is None and max_trials is None:
        raise ValueError("budgeted_search needs a time budget or a number of trials.")
    start, best, trial = time.monotonic(), None, 0
    while (time_budget_s is None or time.monotonic() - start < time_budget_s) and (max_trials is None or trial < max_trials):
        names = list(spaces)
        m = names[trial % len(names)]
        params = draws[m][(trial // len(names)) % SEARCH_DRAWS]
        est = get_model(m, label_col=label, **params)
        model = Pipeline(stages=list(preprocessor.getStages()) + [est]).fit(train)
        auc = ev.evaluate(with_probability(model.transform(val)), label, "score").first()["auc_roc"]
        if best is None or auc > best[2]:
            best = (m, params, auc, model)
        trial += 1
    return best


def mlp_classifier(n_features: int, label: str = "TARGET", features_col: str = "features",
                   seed: int = RANDOM_STATE, max_iter: int = MLP_EPOCHS,
                   hidden: Sequence[int] = MLP_LAYERS,
                   block_size: int = MLP_BATCH) -> MultilayerPerceptronClassifier:
    """Layers [d, *hidden, 2] (default 256-128-64), block size 1024
    (Spark's L-BFGS / gradient descent replace Adam; batch-norm and dropout
    are not available)."""
    return MultilayerPerceptronClassifier(
        featuresCol=features_col, labelCol=label, layers=[n_features, *hidden, 2],
        blockSize=block_size, maxIter=max_iter, stepSize=MLP_LR, seed=seed)


def replicate_positives(df: DataFrame, label: str, times: int = MLP_POS_WEIGHT) -> DataFrame:
    """Positive-class weight for estimators without ``weightCol``: each
    positive row appears ``times`` times (exact for integer weights)."""
    reps = F.when(F.col(label) == 1, F.lit(times)).otherwise(F.lit(1))
    return df.withColumn("_rep", F.explode(F.array_repeat(F.lit(1), reps))).drop("_rep")


def fit_mlp(df: DataFrame, preprocessor: Pipeline, label: str = "TARGET",
            max_iter: int = MLP_EPOCHS, seed: int = RANDOM_STATE,
            hidden: Sequence[int] = MLP_LAYERS, block_size: int = MLP_BATCH,
            pos_weight: int = MLP_POS_WEIGHT):
    """Fit preprocessing, then the MLP on positively-replicated rows
    (``pos_weight`` copies of each positive). Returns (PipelineModel, loss
    history). Passes of the fit read packed rows from the shared folder; copies of a
    row are a weight (:mod:`lendspark.operators.perceptron`)."""
    prep = preprocessor.fit(df)
    n_features = len(prep.transform(df.limit(1)).first()["features"])
    mlp = mlp_classifier(n_features, label, max_iter=max_iter, seed=seed,
                         hidden=hidden, block_size=block_size)
    mm, history = fit_perceptron(prep.transform(df), mlp, times=max(1, int(pos_weight)))
    return PipelineModel(stages=list(prep.stages) + [mm]), history
