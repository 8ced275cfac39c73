"""Preprocessing, folds, models, segmentation,
scoring, streaming and the daily job chain (small inputs)."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lendspark.operators import models as mdl, prep, scoring, segment as seg
from lendspark.sources import io, roles
from lendspark.sources.schemas import check_batch_size, validate

from conftest import SF_SMALL

NUM = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "DAYS_BIRTH", "DAYS_EMPLOYED",
       "CNT_FAM_MEMBERS", "CREDIT_INCOME_RATIO", "AGE_YEARS", "EMPLOYED_YEARS"]
CAT = ["NAME_CONTRACT_TYPE", "NAME_INCOME_TYPE"]


@pytest.fixture(scope="module")
def app(spark):
    return roles.application(spark, SF_SMALL).cache()


class TestPreprocessor:
    def test_three_kinds_of_stage_and_rows_kept(self, df_with_target):
        p = prep.build_preprocessor(["AMT_CREDIT", "DAYS_EMPLOYED", "CREDIT_INCOME_RATIO"],
                                    ["CODE_GENDER", "NAME_INCOME_TYPE"])
        model = p.fit(df_with_target)
        out = model.transform(df_with_target)
        assert out.count() == 10
        arr = np.array([r.features.toArray() for r in out.select("features").collect()])
        assert not np.isnan(arr).any()
        assert arr.shape[1] == 3 + 2 + 3       # 3 numeric, 2 genders, 3 income types

    def test_exact_median_imputation_and_population_scale(self, spark):
        df = spark.createDataFrame([(1.0,), (3.0,), (9.0,), (10.0,), (None,)], "x double")
        m = prep.NumericImputerScaler(inputCols=["x"], outputCols=["z"]).fit(df)
        assert m.getOrDefault(m.medians) == [6.0]                    # exact, not 3.0
        filled = np.array([1, 3, 9, 10, 6.0])
        assert m.getOrDefault(m.means)[0] == pytest.approx(filled.mean())
        assert m.getOrDefault(m.scales)[0] == pytest.approx(filled.std())   # ddof=0

    def test_constant_column_scale_one(self, spark):
        df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
        m = prep.NumericImputerScaler(inputCols=["x"], outputCols=["z"]).fit(df)
        assert m.getOrDefault(m.scales) == [1.0]

    def test_mode_ties_to_smallest_and_unseen_is_zero_vector(self, spark):
        train = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 3.0), ("a", 4.0), (None, 5.0)],
                                      "c string, x double")
        model = prep.build_preprocessor(["x"], ["c"], with_anomaly=False, with_domain=False).fit(train)
        imp = [s for s in model.stages if isinstance(s, prep.ModeImputerModel)][0]
        assert imp.getOrDefault(imp.modes) == ["a"]
        test = spark.createDataFrame([("zzz", 1.0), (None, 1.0), ("b", 1.0)], "c string, x double")
        vecs = [r.features.toArray()[1:].tolist() for r in model.transform(test).collect()]
        assert vecs == [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
        assert prep.feature_names(model) == ["x", "c_a", "c_b"]

    def test_persist_round_trip(self, app, tmp_path):
        model = prep.build_preprocessor(NUM, CAT).fit(app)
        model.write().overwrite().save(str(tmp_path / "p"))
        loaded = PipelineModel.load(str(tmp_path / "p"))
        a = [r.features for r in model.transform(app).orderBy("SK_ID_CURR").collect()]
        b = [r.features for r in loaded.transform(app).orderBy("SK_ID_CURR").collect()]
        assert a == b

    def test_flag_sum_preserved_through_pipeline(self, df_minimal):
        model = prep.build_preprocessor(["DAYS_EMPLOYED"], [], with_domain=False).fit(df_minimal)
        assert model.transform(df_minimal).agg(F.sum("DAYS_EMPLOYED_ANOMALY")).first()[0] == 2


class TestSampling:
    def test_folds_balanced_per_class(self, app):
        f = prep.stratified_folds(app, "TARGET", "SK_ID_CURR", k=5)
        counts = {(r.TARGET, r.fold): r["count"] for r in f.groupBy("TARGET", "fold").count().collect()}
        for t in (0, 1):
            sizes = [counts.get((t, k), 0) for k in range(5)]
            assert max(sizes) - min(sizes) <= 1
        assert f.count() == app.count()

    def test_split_and_sample(self, app):
        s = prep.stratified_split(app, "TARGET", "SK_ID_CURR", 0.2)
        n = app.count()
        assert abs(s.where("split = 'test'").count() - 0.2 * n) <= 2
        smp = prep.sample_rows(app, 50, "SK_ID_CURR")
        assert smp.count() == 50 and smp.select("SK_ID_CURR").distinct().count() == 50
        assert sorted(r[0] for r in smp.select("SK_ID_CURR").collect()) == \
            sorted(r[0] for r in prep.sample_rows(app, 50, "SK_ID_CURR").select("SK_ID_CURR").collect())


class TestModels:
    def test_factory(self):
        assert mdl.get_model("logistic_regression").getMaxIter() == 1000
        assert mdl.get_model("random_forest").getNumTrees() == 200
        assert mdl.get_model("random_forest", numTrees=10).getNumTrees() == 10
        with pytest.raises(ValueError, match="logistic_regression"):
            mdl.get_model("svm")

    def test_balanced_weights(self, spark):
        df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "TARGET int")
        w = {r.TARGET: r.class_weight for r in mdl.add_balanced_weights(df, "TARGET").distinct().collect()}
        assert w[0] == pytest.approx(8 / 12) and w[1] == pytest.approx(8 / 4)

    def test_cross_validation_and_final_fit(self, app, tmp_path):
        p = prep.build_preprocessor(NUM, CAT)
        per, summary = mdl.cross_validate(app, p, "logistic_regression", k=3,
                                          model_kwargs={"maxIter": 20}, runs_path=str(tmp_path / "runs"))
        assert per.count() == 3
        s = summary.first()
        assert s.n_folds == 3 and 0.0 <= s.auc_roc_mean <= 1.0
        assert io.search_runs(app.sparkSession, str(tmp_path / "runs")).count() == 1
        final = mdl.fit_final(app, p, model_kwargs={"maxIter": 20})
        io.save_model(final, str(tmp_path / "m"))
        preds, rejected = scoring.score_applications(io.load_model(str(tmp_path / "m")), app,
                                                     fields=[("AMT_CREDIT", None, True, ("gt", 0))])
        assert preds.count() + rejected.count() == app.count()

    def test_training_error_is_wrapped(self, app):
        with pytest.raises(mdl.ModelTrainingError):
            mdl.cross_validate(app.drop("AMT_CREDIT"), prep.build_preprocessor(NUM, CAT), k=2,
                               checkpoint=False)

    def test_random_search_and_budget(self, app):
        p = prep.build_preprocessor(NUM, CAT)
        space = {"regParam": ("loguniform", 1e-4, 1.0), "maxIter": [10, 20]}
        assert mdl.draw_params(space, 3) == mdl.draw_params(space, 3)
        params, auc, model = mdl.random_search(app, p, space, n_iter=2, k=2)
        assert set(params) == {"regParam", "maxIter"} and 0 <= auc <= 1
        best = mdl.budgeted_search(app, p, {"logistic_regression": {"maxIter": [5, 10]}},
                                   time_budget_s=60, max_trials=2)
        assert best[0] == "logistic_regression" and 0 <= best[2] <= 1

    def test_mlp(self, app):
        model, history = mdl.fit_mlp(app, prep.build_preprocessor(NUM, CAT), max_iter=3)
        assert len(history) >= 1
        assert model.transform(app).select("probability").count() == app.count()


class TestSegmentation:
    def test_kmeans_pca_isolation_forest(self, spark):
        emb = seg.to_vector(roles.table(spark, SF_SMALL, "embeddings"), "embedding")
        n = emb.count()
        clustered, _ = seg.segment_customers(emb, k=3)
        assert clustered.select("cluster").distinct().count() == 3
        proj, ratios = seg.pca_2d(emb)
        assert len(ratios) == 2 and ratios[0] >= ratios[1] > 0
        flags = seg.detect_anomalies(emb, id_col="vec_id", contamination=0.1)
        got = {r.anomalia: r["count"] for r in flags.groupBy("anomalia").count().collect()}
        assert set(got) <= {1, -1} and sum(got.values()) == n
        assert abs(got.get(-1, 0) - 0.1 * n) <= 0.02 * n + 1


class TestScoring:
    def test_band_and_decision_edges(self, spark):
        from lendspark.functions.scalar import decision, score_band
        df = spark.createDataFrame([(p,) for p in [0.1999, 0.2, 0.4, 0.5, 0.6, 0.8]], "p double")
        out = df.select(score_band("p").alias("b"), decision("p").alias("d")).collect()
        assert [r.b for r in out] == ["A", "B", "C", "C", "D", "E"]
        assert [r.d for r in out] == ["APROVADO"] * 3 + ["NEGADO"] * 3

    def test_validation_and_batch_bound(self, spark):
        df = spark.createDataFrame([(1, 100.0, 50.0, -1000, 10), (2, -5.0, None, 5, 10)],
                                   "SK_ID_CURR long, AMT_CREDIT double, AMT_INCOME_TOTAL double, "
                                   "DAYS_BIRTH int, DAYS_EMPLOYED int")
        fields = [("AMT_CREDIT", None, True, ("gt", 0)), ("AMT_INCOME_TOTAL", None, True, ("gt", 0)),
                  ("DAYS_BIRTH", None, True, ("lt", 0))]
        valid, rejected = validate(df, fields)
        assert [r.SK_ID_CURR for r in valid.collect()] == [1]
        assert sorted(rejected.first().errors) == sorted(
            ["AMT_CREDIT: must be > 0", "AMT_INCOME_TOTAL: required", "DAYS_BIRTH: must be < 0"])
        assert check_batch_size(df, 1000) == 2
        with pytest.raises(ValueError):
            check_batch_size(df, 1)

    def test_model_info_and_unavailable(self, spark, tmp_path):
        info = scoring.model_info(spark, str(tmp_path / "none"), ["a"], ["b"]).first()
        assert info.loaded is False
        with pytest.raises(io.ModelUnavailable):
            scoring.score_applications(None, spark.range(1))


def test_stream_equals_batch(spark, app, tmp_path):
    from lendspark.streaming.scoring_stream import read_predictions, start_scoring_stream
    model = mdl.fit_final(app, prep.build_preprocessor(NUM, CAT), model_kwargs={"maxIter": 10})
    fields = [("AMT_CREDIT", None, True, ("gt", 0))]
    app.repartition(3).write.parquet(str(tmp_path / "in"))
    q = start_scoring_stream(spark, model, str(tmp_path / "in"), str(tmp_path / "out"), schema=app.schema,
                             checkpoint_dir=str(tmp_path / "ck"), fields=fields, max_files_per_trigger=1)
    q.awaitTermination()
    streamed = read_predictions(spark, str(tmp_path / "out")).drop("batch_id")
    batch, _ = scoring.score_applications(model, app, fields=fields)
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_daily_job_chain(spark, tmp_path):
    from lendspark.plans import jobs
    rng = np.random.default_rng(0)
    n = 120
    raw = pd.DataFrame({
        "SK_ID_CURR": np.arange(n), "TARGET": rng.integers(0, 2, n),
        "AMT_CREDIT": rng.uniform(1e5, 1e6, n), "AMT_ANNUITY": rng.uniform(1e4, 5e4, n),
        "AMT_INCOME_TOTAL": rng.uniform(5e4, 3e5, n), "AMT_GOODS_PRICE": rng.uniform(1e5, 1e6, n),
        "DAYS_BIRTH": -rng.integers(7000, 25000, n),
        "DAYS_EMPLOYED": np.where(rng.random(n) < 0.2, 365243, -rng.integers(0, 9000, n)),
        "DAYS_REGISTRATION": -rng.uniform(0, 9000, n), "DAYS_ID_PUBLISH": -rng.integers(1, 5000, n),
        "CNT_FAM_MEMBERS": rng.integers(1, 5, n).astype(float),
        "CODE_GENDER": rng.choice(["M", "F"], n), "NAME_INCOME_TYPE": rng.choice(["Working", "Pensioner"], n),
    })
    raw_dir = tmp_path / "raw"
    raw_dir.mkdir()
    raw.to_csv(raw_dir / "application_train.csv", index=False)
    metrics = jobs.run_daily(spark, str(raw_dir), str(tmp_path / "work"), str(tmp_path / "model"),
                             cv_folds=3)
    assert metrics["n_folds"] == 3
    assert spark.table("credit_score.features").count() == n
    assert os.path.isdir(tmp_path / "model")
