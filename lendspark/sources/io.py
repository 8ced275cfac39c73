"""Readers and writers.

CSV and Parquet scans, table / JDBC sinks, catalog listings, Spark ML model
persistence and an append-only table of experiment runs. Every reader returns
a lazy DataFrame: column pruning and filter pushdown reach the scan.
"""

from __future__ import annotations

import datetime as _dt
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from lendspark.functions.nulls import nans_to_nulls
from lendspark.session import cut_lineage

log = logging.getLogger("lendspark.io")


class DataLoadError(Exception):
    """A source file is missing or unreadable; the message names the file."""


class ModelUnavailable(Exception):
    """Scoring was asked for but no fitted model could be loaded."""


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem (works for HDFS / S3 / local)."""
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p)) and bool(fs.getFileStatus(p).isFile())


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             columns: list[str] | None = None, sampling_ratio: float = 1.0) -> DataFrame:
    """Header CSV scan. With an explicit schema nothing is inferred (one pass);
    otherwise types are inferred from ``sampling_ratio`` of the rows. Float NaN
    becomes null (pandas treats NaN as missing)."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True).option("samplingRatio", sampling_ratio)
    df = reader.csv(path)
    if columns:
        df = df.select(*columns)
    return nans_to_nulls(df)


CORRUPT = "_corrupt_record"


def read_csv_quarantined(spark: SparkSession, path: str, schema: T.StructType,
                         strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Header CSV scan that keeps malformed rows apart: (rows of ``schema``, rows (file,
    text) of the lines that do not fit it: a value of another type, or too few or too many
    fields). The scan is kept in the shared folder, so both come from one reading and all
    columns are judged. ``strict`` raises :class:`DataLoadError` if there are such lines,
    with their number, one line and its file."""
    if not path_exists(spark, path):
        raise DataLoadError(f"File not found: {path}")
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    try:
        rows = cut_lineage(spark.read.option("header", True).option("mode", "PERMISSIVE")
                           .option("columnNameOfCorruptRecord", CORRUPT).schema(whole).csv(path)
                           .select("*", F.col("_metadata.file_path").alias("_file")))
    except Exception as exc:  # noqa: BLE001 - an unreadable file ends the read with many types
        raise DataLoadError(f"Error reading {path}: {exc}") from exc
    bad = rows.where(F.col(CORRUPT).isNotNull()).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("text"))
    if strict:
        first = bad.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "text")).alias("one")).first()
        if first["n"]:
            raise DataLoadError(f"{first['n']} malformed rows in {path}; one in {first['one']['file']}: "
                                f"{first['one']['text']}")
    return nans_to_nulls(rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file")), bad


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan, pruned to ``columns``; float NaN becomes null."""
    df = spark.read.parquet(path)
    return nans_to_nulls(df.select(*columns) if columns else df)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Overwrite sink (the reference rewrites its interim / processed files)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


class CreditDataLoader:
    """Named CSV tables under one directory (A1-A4).

    A missing directory only logs a warning; a missing or unreadable file raises
    :class:`DataLoadError` naming the file.
    """

    def __init__(self, spark: SparkSession, data_dir: str = "data/",
                 schemas: dict[str, T.StructType] | None = None):
        self.spark = spark
        self.data_dir = data_dir.rstrip("/")
        self.schemas = schemas or {}
        if not path_exists(spark, self.data_dir):
            log.warning("Directory %s was not found.", self.data_dir)

    def _load_csv(self, filename: str) -> DataFrame:
        path = f"{self.data_dir}/{filename}"
        try:
            # a single file, or a folder of part files as Spark writes CSV
            ok = path_exists(self.spark, path)
        except Exception as exc:  # noqa: BLE001 - any FS error is a load error
            raise DataLoadError(f"Error reading {filename}: {exc}") from exc
        if not ok:
            raise DataLoadError(f"File not found: {path}")
        try:
            return read_csv(self.spark, path, schema=self.schemas.get(filename))
        except AnalysisException as exc:
            raise DataLoadError(f"Error reading {filename}: {exc}") from exc

    def load_application_train(self) -> DataFrame:
        return self._load_csv("application_train.csv")

    def load_application_test(self) -> DataFrame:
        return self._load_csv("application_test.csv")

    def load_bureau(self) -> DataFrame:
        return self._load_csv("bureau.csv")

    def load_previous_applications(self) -> DataFrame:
        return self._load_csv("previous_application.csv")

    def load_credit_card_balance(self) -> DataFrame:
        return self._load_csv("credit_card_balance.csv")

    def load_installments_payments(self) -> DataFrame:
        return self._load_csv("installments_payments.csv")

    def load_all_core_tables(self) -> dict[str, DataFrame]:
        return {
            "application_train": self.load_application_train(),
            "bureau": self.load_bureau(),
            "previous_application": self.load_previous_applications(),
        }


# ---------------------------------------------------------------------------
# Table sinks, SQL scans, catalog
# ---------------------------------------------------------------------------

def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create the database when missing (optionally at ``location``, e.g.
    under the shared folder instead of the session's warehouse)."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{loc}")


def write_table(df: DataFrame, name: str, database: str | None = None,
                fmt: str = "parquet", path: str | None = None,
                database_location: str | None = None) -> str:
    """Replace semantics, the table is rewritten on each run. The rows go to a new
    version folder (below ``path``, or the database's location) first; only when that
    write has ended does one catalog update point the table to it. A failing write leaves
    the old table whole. The version before stays for readers that began with it, older
    ones are removed."""
    spark = df.sparkSession
    if database:
        ensure_database(spark, database, database_location)
    database = database or spark.catalog.currentDatabase()
    full = f"`{database}`.`{name}`"
    root = path or f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{name}.versions"
    location = f"{root.rstrip('/')}/v-{_dt.datetime.now(_dt.timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    df.write.format(fmt).save(location)
    new = spark.read.format(fmt).load(location).schema
    same = spark.catalog.tableExists(full) and spark.table(full).schema == new
    if same:
        spark.sql(f"ALTER TABLE {full} SET LOCATION '{location}'")
        spark.catalog.refreshTable(full)
    elif spark.catalog.tableExists(full):     # other columns: build the table beside it, then take its name
        staged = f"`{database}`.`{name}_{uuid.uuid4().hex[:8]}`"
        spark.sql(f"CREATE TABLE {staged} USING {fmt} LOCATION '{location}'")
        spark.sql(f"DROP TABLE {full}")
        spark.sql(f"ALTER TABLE {staged} RENAME TO {full}")
    else:
        spark.sql(f"CREATE TABLE {full} USING {fmt} LOCATION '{location}'")
    fs, folder = _fs_path(spark, root)
    versions = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v-")),
                      key=lambda p: p.getName())
    for old in versions[:-2]:
        fs.delete(old, True)
    return full


def write_jdbc(df: DataFrame, url: str, table_name: str, properties: dict | None = None,
               batch_size: int = 10_000) -> None:
    """JDBC replace sink; each partition writes in ``batch_size``-row batches.
    (Not exercised in tests: it needs an external database.)"""
    (df.write.mode("overwrite").option("batchsize", batch_size)
       .option("truncate", "false")
       .jdbc(url, table_name, properties=properties or {}))


def sql_scan(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


def list_databases(spark: SparkSession) -> DataFrame:
    rows = [(d.name, d.description, d.locationUri) for d in spark.catalog.listDatabases()]
    return spark.createDataFrame(rows, "name string, description string, location string")


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    rows = [(t.name, t.database, t.tableType, bool(t.isTemporary))
            for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, database string, table_type string, is_temporary boolean")


def list_columns(spark: SparkSession, table_name: str, database: str | None = None) -> DataFrame:
    """Columns in ordinal order, like ``information_schema.columns``."""
    cols = spark.catalog.listColumns(table_name, database)
    rows = [(i + 1, c.name, c.dataType, bool(c.nullable)) for i, c in enumerate(cols)]
    return spark.createDataFrame(
        rows, "ordinal_position int, column_name string, data_type string, is_nullable boolean")


# ---------------------------------------------------------------------------
# Models and runs
# ---------------------------------------------------------------------------

def save_model(model, path: str, metrics: dict | None = None, runs_path: str | None = None,
               source: str = "train") -> str:
    """Overwrite-save a fitted ``PipelineModel``; optionally log the run."""
    model.write().overwrite().save(path)
    if runs_path is not None:
        log_run(model_spark(model), runs_path, source=source,
                params={"model_path": path}, metrics=metrics or {})
    return path


def model_spark(model) -> SparkSession:
    return SparkSession.getActiveSession()


def load_model(path: str):
    """Load a saved ``PipelineModel``; a missing or unreadable model is reported as
    :class:`ModelUnavailable` (the caller decides, it is not a crash)."""
    from pyspark.ml import PipelineModel

    spark = SparkSession.getActiveSession()
    if spark is None or not path_exists(spark, path):
        raise ModelUnavailable(f"Model not available at {path}")
    try:
        return PipelineModel.load(path)
    except Exception as exc:  # noqa: BLE001 - damaged files end the load with many types
        raise ModelUnavailable(f"Model at {path} cannot be read: {exc}") from exc


RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("source", T.StringType(), True),
    T.StructField("params", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("ts", T.TimestampType(), True),
])


def log_run(spark: SparkSession, runs_path: str, source: str, params: dict | None = None,
            metrics: dict | None = None, tags: dict | None = None) -> str:
    """Append one experiment run (params, metrics, tags) to a Parquet table."""
    run_id = uuid.uuid4().hex
    row = (run_id, source,
           {str(k): str(v) for k, v in (params or {}).items()},
           {str(k): float(v) for k, v in (metrics or {}).items() if v is not None},
           {str(k): str(v) for k, v in (tags or {}).items()},
           _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))
    spark.createDataFrame([row], RUNS_SCHEMA).write.mode("append").parquet(runs_path)
    return run_id


def search_runs(spark: SparkSession, runs_path: str, metric: str | None = None) -> DataFrame:
    """Runs as a table; with ``metric``, sorted best-first on it."""
    df = spark.read.schema(RUNS_SCHEMA).parquet(runs_path)
    if metric:
        df = (df.withColumn(metric, F.element_at("metrics", metric))
                .orderBy(F.col(metric).desc_nulls_last(), "run_id"))
    return df
