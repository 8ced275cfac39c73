"""The search over L2 terms: one set of packed rows and shared passes, Spark's own results."""

import numpy as np
import pytest
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from lendspark.operators import evaluate as ev, logistic, models as mdl, prep, segment

COLS = ["a", "b", "c", "flat"]
SPACE = {"regParam": ("loguniform", 1e-4, 1.0)}


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(1200, 4)) * [1, 5, 0.2, 0] + [0, 3, 0, 7], 2)
    y = (x[:, 0] + 0.2 * x[:, 1] + rng.normal(size=1200) > 1.2).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(1200)] + [(5000, None, 0.0, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, " + ", ".join(f"{c} double" for c in COLS)).cache()


def by_spark(df, pre, n_iter, k):
    est = mdl.get_model("logistic_regression")
    draws = mdl.draw_params(SPACE, n_iter)
    folded = mdl.add_balanced_weights(prep.stratified_folds(df, "TARGET", "SK_ID_CURR", k=k), "TARGET").cache()
    pipe = mdl.Pipeline(stages=list(pre.getStages()) + [est])
    return draws, CrossValidator(estimator=pipe, estimatorParamMaps=[{est.regParam: d["regParam"]} for d in draws],
                                 evaluator=ev.ExactAUC("TARGET"), foldCol="fold", numFolds=k).fit(folded)


@pytest.mark.parametrize("stages", [False, True])
def test_search_is_that_of_the_cross_validator(spark, raw, stages, monkeypatch):
    df = raw if stages else segment.to_vector(raw, COLS).select("SK_ID_CURR", "TARGET", "features")
    pre = prep.build_preprocessor(COLS, [], with_anomaly=False, with_domain=False) if stages else prep.passthrough()
    draws, want = by_spark(df, pre, 2, 2)
    i = int(np.argmax(want.avgMetrics))
    monkeypatch.setattr(mdl, "CrossValidator", None)        # caches folds and copies of them
    monkeypatch.setattr(logistic, "SLICE_ROWS", 90)
    monkeypatch.setattr(logistic, "FLUSH_ROWS", 130)
    monkeypatch.setattr(logistic, "SCORED_AT_ONCE", 1)
    best, auc, model = mdl.random_search(df, pre, SPACE, n_iter=2, k=2)
    assert best == draws[i] and auc == pytest.approx(want.avgMetrics[i], abs=1e-12)
    got, ref = model.stages[-1], want.bestModel.stages[-1]
    assert np.allclose(got.coefficients.toArray(), ref.coefficients.toArray(), rtol=1e-7, atol=1e-9)
    assert got.intercept == pytest.approx(ref.intercept, rel=1e-7) and got.getRegParam() == best["regParam"]
    a, b = (mdl.with_probability(m.transform(df)).orderBy("SK_ID_CURR").select("score").collect() for m in (model, want.bestModel))
    assert [r.score for r in a] == pytest.approx([r.score for r in b], abs=1e-9) and len(a) == 1201


def test_one_pass_serves_all_fits(spark, raw, monkeypatch):
    df = segment.to_vector(raw, COLS).select("SK_ID_CURR", "TARGET", "features")
    folded = prep.stratified_folds(df, "TARGET", "SK_ID_CURR", k=3)
    blocks = logistic.fold_blocks(folded, "features", "TARGET")
    passes = []
    sums = logistic.block_sums
    monkeypatch.setattr(logistic, "block_sums", lambda *a: passes.append(1) or sums(*a))
    moments = logistic.Moments(blocks, 3, (1.0, 1.0))
    one = len(passes)
    fits = [(f, r) for f in range(3) for r in (1e-3, 1e-2, 0.1, 1.0)]
    logistic.fit_many(blocks, moments, (1.0, 1.0), fits, 5, 1e-9)
    assert len(passes) - one < 12                           # five iterations of twelve fits
    total, hit, mean, std = moments.without(0)
    rows = [r.features for r in folded.where("fold != 0").collect()]
    assert total == len(rows) and np.allclose(mean, np.mean([v.toArray() for v in rows], 0))
    assert np.allclose(std, np.std([v.toArray() for v in rows], 0, ddof=1))


def test_auc_slices_share_ties(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(700, 1)), 1)
    df = segment.to_vector(spark.createDataFrame([(i, int(rng.random() < 0.4 + 0.1 * x[i, 0]), float(x[i, 0]), i % 2) for i in range(700)],
                                                 "id long, TARGET int, a double, fold int"), ["a"]).repartition(3, "id").cache()
    blocks = logistic.fold_blocks(df, "features", "TARGET")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(logistic, "SLICE_ROWS", 60)
        got = logistic.exact_aucs(blocks, {1: [(np.array([1.0]), 0.0), (np.array([-2.0]), 1.0)]}, np.array([350, 350]))
    want = ev.evaluate(df.where("fold = 1").select(F.col("TARGET").alias("label"), F.col("a").alias("score"))).first().auc_roc
    assert got[1] == pytest.approx([want, 1 - want], abs=1e-12)
