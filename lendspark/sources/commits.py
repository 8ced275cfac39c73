"""Commit logs: which written folders of an output are complete.

A batch writes its rows to a folder of its own and, when that write has ended, one small
entry into ``<output>/_commits``: a file of a temporary name, renamed to the batch's
number. Readers list the entries and read the folders they name, so a half-written folder
is invisible, and a batch that runs again after its entry exists changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lendspark.sources.io import DataLoadError, _fs_path

LOG = "_commits"


@dataclass(frozen=True)
class Commit:
    batch_id: int
    folders: list[str]      # relative to the output, in the order of reading
    replaces: bool          # the folders hold everything committed before, too


def _name(batch_id: int) -> str:
    return f"{batch_id:020d}"


def committed(spark: SparkSession, output: str) -> list[Commit]:
    """Entries by batch number, from the last one that replaces all before it."""
    fs, log = _fs_path(spark, f"{output}/{LOG}")
    if not fs.exists(log):
        return []
    out = []
    for status in fs.listStatus(log):
        name = status.getPath().getName()
        number = name.removesuffix("-all")
        if number.isdigit():
            stream = fs.open(status.getPath())
            try:
                entry = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
            out.append(Commit(int(number), entry["folders"], entry["replaces"]))
    out.sort(key=lambda c: (c.batch_id, c.replaces))
    last = max((k for k, c in enumerate(out) if c.replaces), default=0)
    return out[last:]


def is_committed(spark: SparkSession, output: str, batch_id: int) -> bool:
    fs, path = _fs_path(spark, f"{output}/{LOG}/{_name(batch_id)}")
    return bool(fs.exists(path))


def commit(spark: SparkSession, output: str, batch_id: int, folders: list[str], replaces: bool = False) -> bool:
    """Write the entry of a batch last; False if it exists already (the first one stays).
    An entry that ``replaces`` all before it has a name of its own behind the batch's."""
    fs, target = _fs_path(spark, f"{output}/{LOG}/{_name(batch_id)}{'-all' if replaces else ''}")
    _, draft = _fs_path(spark, f"{output}/{LOG}/.{uuid.uuid4().hex}")
    if fs.exists(target):
        return False
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps({"folders": folders, "replaces": replaces}).encode()))
    finally:
        stream.close()
    if fs.rename(draft, target):
        return True
    fs.delete(draft, False)
    return False


def write_batch(df: DataFrame, output: str, batch_id: int, partition_by: str | None = None) -> bool:
    """Write ``df`` as the batch's folder and commit it; False if the batch was there."""
    spark = df.sparkSession
    if is_committed(spark, output, batch_id):
        return False
    folder = f"batch_id={batch_id}/attempt=a{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(f"{output}/{folder}")
    return commit(spark, output, batch_id, [folder])


def read_committed(spark: SparkSession, output: str) -> DataFrame:
    """The rows of all committed batches, with ``batch_id``."""
    folders = [f for c in committed(spark, output) for f in c.folders]
    if not folders:
        raise DataLoadError(f"No batch is committed in {output}")
    return (spark.read.option("basePath", output).parquet(*[f"{output}/{f}" for f in folders]).drop("attempt"))
