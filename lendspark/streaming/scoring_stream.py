"""Continuous scoring of arriving application files.

``readStream`` with a fixed schema -> validation -> fitted pipeline ->
predictions. Each micro-batch is written once, by status (scored or rejected),
to a folder of its own, and committed last: readers follow the commit log, so a
half-written batch is invisible and a batch that runs again counts once. Progress
lives in the checkpoint folder. Stateless on purpose: no event time exists in the data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lendspark.functions.scalar import DEFAULT_THRESHOLD
from lendspark.operators.scoring import REJECTED, SCORED, score_all
from lendspark.session import ensure_checkpoint_dir
from lendspark.sources import commits
from lendspark.sources.schemas import APPLICATION_FIELDS, APPLICATION_SCHEMA


def start_scoring_stream(spark: SparkSession, model, input_dir: str, output_dir: str,
                         schema: StructType = APPLICATION_SCHEMA, fmt: str = "parquet",
                         checkpoint_dir: str | None = None, threshold: float = DEFAULT_THRESHOLD,
                         keep=("SK_ID_CURR",), available_now: bool = True,
                         max_files_per_trigger: int | None = None, fields=APPLICATION_FIELDS):
    """Start the stream; returns the ``StreamingQuery``. With
    ``available_now`` it processes what is there and stops (the incremental
    daily run); otherwise it keeps polling."""
    if checkpoint_dir is None:
        checkpoint_dir = os.path.join(ensure_checkpoint_dir(spark), "scoring_stream")
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.load(input_dir)
    keep = [k for k in keep if k in schema.fieldNames()]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        commits.write_batch(score_all(model, batch, threshold, keep, fields), output_dir, batch_id, "status")

    writer = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_scored(spark: SparkSession, output_dir: str) -> DataFrame:
    """Every application of the committed batches, with status, errors and prediction."""
    return commits.read_committed(spark, output_dir)


def read_predictions(spark: SparkSession, output_dir: str) -> DataFrame:
    return read_scored(spark, output_dir).where(F.col("status") == SCORED).drop("status", "errors")


def read_rejected(spark: SparkSession, output_dir: str) -> DataFrame:
    rows = read_scored(spark, output_dir).where(F.col("status") == REJECTED)
    return rows.withColumn("errors", F.split("errors", "; ")).withColumn("n_errors", F.size("errors"))
