"""Registered model queries (K3, L13, L15, L16, A12, A13, N4) on the
smallest driver tables: shapes, ranges and the invariants each one promises."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lendspark.operators import models as mdl, prep
from lendspark.plans import catalog_ml as cml

from conftest import SF_SMALL

from lendspark.operators import scoring


@pytest.fixture(scope="module")
def qs():
    return entry.queries()


def test_model_metadata_available_and_missing(spark, qs, tmp_path):
    _, path = cml._saved_model(spark, SF_SMALL)
    (tmp_path / "no-model").mkdir()          # a folder that holds no model
    info = [scoring.model_info(spark, p, cml.NUM, cml.CAT).first() for p in (path, str(tmp_path / "no-model"))]
    rows = {r["loaded"]: r for r in info}
    assert rows[True]["model_name"] == "LogisticRegressionModel" and rows[False]["model_name"] == ""
    assert set(rows) == {True, False}
    assert rows[True]["status"] != rows[False]["status"]
    assert rows[True]["features_numeric"] == cml.NUM
    assert rows[True]["features_categorical"] == cml.CAT


def test_model_comparison_one_row_per_model(spark, qs):
    rows = qs["model_comparison_holdout"](spark, SF_SMALL).collect()
    assert sorted(r["model"] for r in rows) == sorted(mdl.AVAILABLE_MODELS)
    for r in rows:
        assert 0.0 <= r["auc_roc"] <= 1.0
        assert r["gini"] == pytest.approx(2 * r["auc_roc"] - 1)
        assert 0.0 <= r["ks_stat"] <= 1.0
    aucs = [r["auc_roc"] for r in rows]
    assert aucs == sorted(aucs, reverse=True)


def test_random_search_maps_C_to_reg_param(spark, qs):
    r = qs["random_search_logistic"](spark, SF_SMALL).first()
    n = roles_count(spark) * (cml.SEARCH_FOLDS - 1) / cml.SEARCH_FOLDS
    assert r["best_C"] * r["best_reg_param"] * n == pytest.approx(1.0)
    assert cml.SEARCH_C_RANGE[0] <= r["best_C"] <= cml.SEARCH_C_RANGE[1]
    assert r["n_draws"] == mdl.SEARCH_DRAWS and r["cv_folds"] == cml.SEARCH_FOLDS
    assert 0.5 <= r["best_auc_mean"] <= 1.0


def roles_count(spark):
    from lendspark.sources import roles
    return roles.application(spark, SF_SMALL).count()


def test_mlp_layers_follow_arguments(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), i % 2) for i in range(60)],
                               "a double, b double, TARGET int")
    pipe = prep.build_preprocessor(["a", "b"], [], with_anomaly=False, with_domain=False)
    model, history = mdl.fit_mlp(df, pipe, max_iter=3, hidden=(4,), block_size=16, pos_weight=2)
    assert model.stages[-1].getLayers() == [2, 4, 2]
    assert 1 <= len(history) <= 4


def test_replicated_positives_count(spark):
    df = spark.createDataFrame([(1,), (0,), (1,)], "TARGET int")
    out = mdl.replicate_positives(df, "TARGET", times=3)
    assert out.where(F.col("TARGET") == 1).count() == 6
    assert out.where(F.col("TARGET") == 0).count() == 1
