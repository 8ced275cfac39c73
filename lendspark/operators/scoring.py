"""Scoring.

A fitted ``PipelineModel`` scores any number of applications in one set-based
``transform``: probability of default (rounded to 4), decision at the
threshold and risk band (both on the unrounded probability).
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendspark.functions.nulls import round_half_even
from lendspark.functions.scalar import DEFAULT_THRESHOLD, decision, score_band
from lendspark.sources import io
from lendspark.sources.schemas import APPLICATION_FIELDS, check_batch_size, validate

# Fixed values (must equal the reference's for the same results)
STATUS_AVAILABLE = "disponível"
STATUS_UNAVAILABLE = "indisponível"

SCORED, REJECTED = "scored", "rejected"
log = logging.getLogger(__name__)


def predictions(scored: DataFrame, prob_col: str = "probability",
                threshold: float = DEFAULT_THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """I8 + I10 on a transformed frame."""
    p = vector_to_array(prob_col)[1]
    return scored.select(
        *[F.col(k) for k in keep],
        round_half_even(p, 4).alias("probability_default"),
        decision(p, threshold).alias("decision"),
        score_band(p).alias("score_band"),
        F.lit(float(threshold)).alias("threshold"))


def score_applications(model, df: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                       keep: Sequence[str] = ("SK_ID_CURR",), max_rows: int | None = None,
                       fields=APPLICATION_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Validate, then score the valid rows. Returns (predictions,
    rejected rows with their ``errors``). ``max_rows`` bounds a request
    batch (B17); off by default."""
    if model is None:
        raise io.ModelUnavailable("Model not available.")
    if max_rows is not None:
        check_batch_size(df, max_rows)
    valid, rejected = validate(df, fields)
    keep = [k for k in keep if k in df.columns]
    return predictions(model.transform(valid), threshold=threshold, keep=keep), rejected


def score_all(model, df: DataFrame, threshold: float = DEFAULT_THRESHOLD,
              keep: Sequence[str] = ("SK_ID_CURR",), fields=APPLICATION_FIELDS) -> DataFrame:
    """N1-N3 as one table: every application with ``status`` (scored or rejected), its
    ``errors`` and, when scored, the prediction."""
    preds, rejected = score_applications(model, df, threshold, keep, fields=fields)
    keep = [k for k in keep if k in df.columns]
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in preds.schema.fields
            if f.name not in keep}
    names = [*keep, "status", "errors", *none]
    scored = preds.withColumn("status", F.lit(SCORED)).withColumn("errors", F.lit(""))
    refused = rejected.select(*keep, F.array_join("errors", "; ").alias("errors"),
                              F.lit(REJECTED).alias("status"), *none.values())
    return scored.select(*names).unionByName(refused.select(*names))


def batch_total(preds: DataFrame) -> DataFrame:
    """``total`` of a batch response."""
    return preds.agg(F.count(F.lit(1)).alias("total"))


def model_info(spark: SparkSession, model_path: str, numeric: Sequence[str],
               categorical: Sequence[str]) -> DataFrame:
    """One row of model metadata: the last stage's class name, and whether the
    model can be loaded (not only whether its folder exists)."""
    try:
        stages = io.load_model(model_path).stages
        name, loaded = type(stages[-1]).__name__ if stages else "", True
    except Exception as exc:  # noqa: BLE001 - whatever keeps it from loading, it is unavailable
        log.warning("Model at %s cannot be loaded: %s", model_path, str(exc).split("\n")[0])
        name, loaded = "", False
    return spark.createDataFrame(
        [(name, model_path, list(numeric), list(categorical),
          STATUS_AVAILABLE if loaded else STATUS_UNAVAILABLE, loaded)],
        "model_name string, model_path string, features_numeric array<string>, "
        "features_categorical array<string>, status string, loaded boolean")
