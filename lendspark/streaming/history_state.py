"""History aggregates kept up to date from arriving files.

Every measure of the history tables is a quotient or a sum of additive parts, so a batch
of new rows is one small table of parts per applicant. A micro-batch adds its parts as a
committed folder; readers sum the parts of all committed folders. After ``COMPACT`` folders the
sums are written as one that replaces them. Nothing that was read before is read again,
a batch that is run twice counts once, and a batch cut short is invisible.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lendspark.functions.nulls import floor_at_zero, safe_ratio
from lendspark.session import ensure_checkpoint_dir
from lendspark.sources import commits

COMPACT = 16
KEY = "SK_ID_CURR"


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def bureau_parts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(KEY).agg(
        F.count("SK_ID_BUREAU").alias("loans"),
        F.count_if(F.col("CREDIT_ACTIVE").eqNullSafe(F.lit("Active"))).alias("active"),
        _total(F.col("AMT_CREDIT_SUM")).alias("amount"),
        _total(F.col("DAYS_CREDIT")).alias("days"), F.count("DAYS_CREDIT").alias("days_n"))


def card_parts(rows: DataFrame) -> DataFrame:
    used = safe_ratio("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL")
    return rows.groupBy(KEY).agg(
        _total(used).alias("used"), F.count(used).alias("used_n"),
        _total(F.col("AMT_DRAWINGS_CURRENT")).alias("drawings"), F.count_if(F.col("AMT_BALANCE") > 0).alias("months"))


def installment_parts(rows: DataFrame) -> DataFrame:
    ratio = safe_ratio("AMT_PAYMENT", "AMT_INSTALMENT")
    late = floor_at_zero(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"))
    return rows.groupBy(KEY).agg(
        _total(ratio).alias("ratio"), F.count(ratio).alias("ratio_n"),
        _total(late).alias("late"), F.count(late).alias("late_n"), F.count_if(late > 0).alias("late_count"))


def _mean(total: str, n: str) -> Column:
    return F.try_divide(F.col(total), F.col(n).cast("double"))


PARTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "bureau": bureau_parts, "credit_card": card_parts, "installments": installment_parts}
MEASURES: dict[str, dict[str, Column | Callable[[], Column]]] = {
    "bureau": {"bureau_loan_count": lambda: F.col("loans"), "bureau_active_loans": lambda: F.col("active"),
               "bureau_total_credit_sum": lambda: F.col("amount"),
               "bureau_mean_days_credit": lambda: _mean("days", "days_n")},
    "credit_card": {"cc_utilization_mean": lambda: _mean("used", "used_n"),
                    "cc_drawings_total": lambda: F.col("drawings"),
                    "cc_months_with_balance": lambda: F.col("months")},
    "installments": {"install_payment_ratio_mean": lambda: _mean("ratio", "ratio_n"),
                     "install_days_late_mean": lambda: _mean("late", "late_n"),
                     "install_late_count": lambda: F.col("late_count")},
}


def _summed(parts: DataFrame) -> DataFrame:
    names = [c for c in parts.columns if c not in (KEY, "batch_id")]
    return parts.groupBy(KEY).agg(*[F.sum(c).alias(c) for c in names])


def add_batch(rows: DataFrame, table: str, state_dir: str, batch_id: int) -> bool:
    """Add the rows of one batch to the state; False if the batch is in it already."""
    parts = PARTS[table](rows.where(F.col(KEY).isNotNull()))
    added = commits.write_batch(parts, state_dir, batch_id)
    if added:
        compact(rows.sparkSession, state_dir, batch_id)
    return added


def compact(spark: SparkSession, state_dir: str, batch_id: int, least: int | None = None) -> bool:
    """Replace the committed folders by one with their sums, if there are ``least``. Its
    entry comes behind the newest batch's and replaces all before it, so a reader sees
    either the old folders or the new one."""
    entries = commits.committed(spark, state_dir)
    if len(entries) < (least or COMPACT) or entries[-1].batch_id != batch_id:
        return False
    folder = f"batch_id={batch_id}/attempt=a{uuid.uuid4().hex}"
    _summed(commits.read_committed(spark, state_dir)).write.parquet(f"{state_dir}/{folder}")
    return commits.commit(spark, state_dir, batch_id, [folder], replaces=True)


def start_history_stream(spark: SparkSession, table: str, input_dir: str, state_dir: str, schema: StructType,
                         fmt: str = "parquet", checkpoint_dir: str | None = None,
                         max_files_per_trigger: int | None = None):
    """Process the files that arrived since the last run (``availableNow``) and stop;
    returns the ``StreamingQuery``. Progress lives in the checkpoint folder, one for
    each state folder."""
    if table not in PARTS:
        raise ValueError(f"Unknown history table '{table}': use one of {sorted(PARTS)}.")
    if checkpoint_dir is None:
        checkpoint_dir = os.path.join(ensure_checkpoint_dir(spark), f"history_stream_{table}")
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def add(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, table, state_dir, batch_id)

    return (reader.load(input_dir).writeStream.foreachBatch(add)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def read_aggregates(spark: SparkSession, table: str, state_dir: str) -> DataFrame:
    """The table's D measures per applicant over everything committed."""
    total = _summed(commits.read_committed(spark, state_dir))
    return total.select(KEY, *[c().alias(name) for name, c in MEASURES[table].items()])
