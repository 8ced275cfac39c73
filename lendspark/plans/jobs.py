"""The daily chain extract -> transform -> load -> train.

Each step is a function passing a path on to the next (the stage boundary is
storage, as in the reference's DAG). Unlike the reference, one pipeline is
fitted on **raw** rows and used for CV, the final fit and scoring, so the
transforms run once and training never sees already-scaled data.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendspark.operators import features as feat
from lendspark.operators import models as mdl
from lendspark.operators.prep import build_preprocessor, processed_frame
from lendspark.operators.profile import null_share_gate
from lendspark.sources import io

log = logging.getLogger("lendspark.jobs")

# Fixed values (must equal the reference's for the same results)
NUMERIC_COLS = [
    "AMT_CREDIT", "AMT_ANNUITY", "AMT_INCOME_TOTAL", "AMT_GOODS_PRICE", "DAYS_BIRTH",
    "DAYS_EMPLOYED", "DAYS_REGISTRATION", "DAYS_ID_PUBLISH", "CNT_FAM_MEMBERS",
    "CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "CREDIT_TERM_MONTHS", "INCOME_PER_FAMILY_MEMBER",
    "AGE_YEARS", "EMPLOYED_YEARS", "EMPLOYED_TO_AGE_RATIO",
]
CATEGORICAL_COLS = [
    "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_INCOME_TYPE",
    "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE",
]
DB_SCHEMA = "credit_score"
FEATURES_TABLE = "features"
NULL_WARN_PCT = 5.0


def extract(spark: SparkSession, raw_dir: str, interim_dir: str) -> str:
    """CSV -> Parquet staging of the application table; returns its path."""
    df = io.CreditDataLoader(spark, raw_dir).load_application_train()
    return io.write_parquet(df, f"{interim_dir.rstrip('/')}/application_train.parquet")


def transform(spark: SparkSession, interim_path: str, processed_path: str,
              numeric: Sequence[str] = NUMERIC_COLS, categorical: Sequence[str] = CATEGORICAL_COLS,
              id_col: str = "SK_ID_CURR", label: str = "TARGET", history: dict | None = None) -> str:
    """Fit the preprocessor on raw rows (optionally enriched with history
    aggregates) and write the named model matrix with id + label."""
    raw = spark.read.parquet(interim_path)
    if history:
        raw = feat.enrich_with_history(raw, **history, key=id_col)
    num = [c for c in numeric if c in raw.columns or c in _DERIVED]
    cat = [c for c in categorical if c in raw.columns]
    model = build_preprocessor(num, cat).fit(raw)
    return io.write_parquet(processed_frame(model, raw, keep=(id_col, label)), processed_path)


_DERIVED = {"CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "CREDIT_TERM_MONTHS", "AGE_YEARS",
            "EMPLOYED_YEARS", "EMPLOYED_TO_AGE_RATIO", "INCOME_PER_FAMILY_MEMBER",
            "bureau_loan_count", "bureau_active_loans", "bureau_total_credit_sum",
            "bureau_mean_days_credit", "cc_utilization_mean", "cc_drawings_total",
            "cc_months_with_balance", "install_payment_ratio_mean", "install_days_late_mean",
            "install_late_count"}


def load(spark: SparkSession, processed_path: str, database: str = DB_SCHEMA,
         table: str = FEATURES_TABLE) -> str:
    """Null gate (warn only) then replace the features table."""
    df = spark.read.parquet(processed_path)
    gate = null_share_gate(df, NULL_WARN_PCT).first()
    if gate["warn"]:
        log.warning("Mean null share %.2f%% is above %.1f%%", gate["mean_null_pct"], NULL_WARN_PCT)
    return io.write_table(df, table, database=database)


def train(spark: SparkSession, interim_path: str, model_path: str,
          numeric: Sequence[str] = NUMERIC_COLS, categorical: Sequence[str] = CATEGORICAL_COLS,
          model_name: str = "logistic_regression", cv_folds: int = 5, label: str = "TARGET",
          id_col: str = "SK_ID_CURR", runs_path: str | None = None,
          history: dict | None = None) -> dict:
    """CV on raw rows with the full pipeline, final refit, save; returns the
    aggregated CV metrics."""
    raw = spark.read.parquet(interim_path)
    if history:
        raw = feat.enrich_with_history(raw, **history, key=id_col)
    raw = raw.where(F.col(label).isNotNull())
    num = [c for c in numeric if c in raw.columns or c in _DERIVED]
    cat = [c for c in categorical if c in raw.columns]
    prep = build_preprocessor(num, cat)
    _, summary = mdl.cross_validate(raw, prep, model_name, label, id_col, k=cv_folds,
                                    runs_path=runs_path)
    metrics = summary.first().asDict()
    final = mdl.fit_final(raw, prep, model_name, label)
    io.save_model(final, model_path, metrics=metrics, runs_path=runs_path, source="final_fit")
    return metrics


def run_daily(spark: SparkSession, raw_dir: str, work_dir: str, model_path: str, **kw) -> dict:
    """extract -> transform -> load -> train, in that order."""
    interim = extract(spark, raw_dir, f"{work_dir}/interim")
    processed = transform(spark, interim, f"{work_dir}/processed/features.parquet")
    load(spark, processed)
    return train(spark, interim, model_path, **kw)
