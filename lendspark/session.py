"""SparkSession defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on. ANSI stays on (Spark 4 default): errors surface
# instead of silent nulls, so the library uses try_divide where null is intended.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app_name: str = "lendspark",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with the library defaults.

    On a cluster the session normally already exists (spark-submit); then only
    the checkpoint folder is ensured.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset (local
    runs, tests) create a private scratch folder for it."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="lendspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    ship_package(spark, current)
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


PART_ROWS = 100_000       # rows of one partition of a table that models are fitted on


def cut_spread(df: DataFrame, n: int | None = None) -> DataFrame:
    """:func:`cut_lineage` of a table that many passes follow, dealt evenly over
    partitions of at most about ``PART_ROWS`` rows. A scan's tasks follow the files' row
    groups, those of a join its few keys; a small table keeps its partitions. ``n``: its
    rows, or a bound of them, where known."""
    parts = -(-(df.count() if n is None else n) // PART_ROWS)
    # by a hash of whole rows: the same places when a task runs again, without a sort
    return cut_lineage(df.repartition(parts, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])) if parts > 1 else df)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession, base: str | None = None) -> None:
    """Make ``lendspark`` importable in executor Python workers (needed by
    the pandas UDFs): zip the package once per SparkContext, in memory,
    write the archive into the shared checkpoint folder through the Hadoop
    FileSystem API (no machine-local scratch) and add it with ``addPyFile``
    (what ``--py-files`` does at submit time)."""
    import io
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    if base is None:
        base = ensure_checkpoint_dir(spark)
        if key in _SHIPPED:
            return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    target = f"{base.rstrip('/')}/pyfiles-{key}/lendspark.zip"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(key)
