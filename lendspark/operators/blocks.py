"""Rows as packed blocks, for fits that pass over them many times in numpy.

A block is a run of rows of one partition, in their order, in one binary cell: its columns
are kept bit by bit, those of few values as codes. A pass decodes one block after the other,
so a task holds one block at a time whatever its partition's size, and nothing is cached in
memory; sums of tasks are added ``MERGE`` at a time, in the order of the partitions.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.session import cut_lineage, ship_package

MERGE = 64                # tasks' sums that one task adds
LOOK = 512                # values that tell whether a column's codes can be fewer than its rows
BLOCKS = "part int, block binary"


def _pack(column: np.ndarray):
    """(values, codes, rows) of one column; codes are None for the values as they are."""
    bits = np.ascontiguousarray(column, np.float64).view(np.int64)
    other = bits != bits[0]
    second = bits[int(other.argmax())]
    if (bits[other] == second).all():                            # two values, or one
        values = np.array([bits[0], second])
        return values.view(np.float64), np.packbits(other)
    if len(np.unique(bits[:LOOK])) > LOOK // 2:
        return bits.view(np.float64), None
    values, codes = np.unique(bits, return_inverse=True)
    if len(values) <= 256:
        codes = codes.astype(np.uint8)
    elif len(values) <= min(65536, len(bits) // 2):
        codes = codes.astype(np.uint16)
    else:
        values, codes = bits, None
    return values.view(np.float64), codes


def pack(x: np.ndarray, *columns: np.ndarray, **constants) -> bytes:
    """A block of a row matrix (rows x columns) and further columns."""
    wide = [*np.asarray(x, np.float64).T, *columns]
    return pickle.dumps((len(x), len(columns), [_pack(c) for c in wide], constants), protocol=5)


def unpack(block: bytes) -> tuple[np.ndarray, list[np.ndarray], dict]:
    """The matrix, one column of the rows in each of its lines, further columns, constants."""
    n, more, packed, constants = pickle.loads(block)
    out = np.empty((len(packed), n))
    for line, (values, codes) in zip(out, packed):
        if codes is None:
            line[:] = values
        elif len(values) == 2:
            np.take(values, np.unpackbits(codes, count=n), out=line)
        else:
            np.take(values, codes, out=line)
    d = len(packed) - more
    return out[:d], list(out[d:]), constants


def matrix(column: pa.Array) -> np.ndarray:
    """Rows x columns of an array column whose arrays have one length."""
    if column.null_count:
        raise ValueError("A row has no feature vector.")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def make_blocks(df: DataFrame, packer: Callable[[Iterator[pa.RecordBatch]], Iterable[bytes]]) -> DataFrame:
    """(part, block): what ``packer`` makes of each partition, kept in the shared folder."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for block in packer(batches):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.binary())})
    return cut_lineage(df.mapInArrow(run, BLOCKS))


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        yield from zip(batch.column("part").to_pylist(), (b.as_py() for b in batch.column("block")))


def block_sums(blocks: DataFrame, of_block: Callable[..., np.ndarray],
               combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray | None:
    """``of_block`` of every block (its lines, further columns, constants), added up or
    otherwise combined; None without blocks."""
    schema = "part int, sums binary"

    def row(part: int, total: np.ndarray) -> dict:
        return {"part": pa.array([part], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for part, block in each_block(batches):
            one = of_block(*unpack(block))
            total = one if total is None else combine(total, one)
        if total is not None:
            yield pa.RecordBatch.from_pydict(row(part, total))

    def merge(table: pa.Table) -> pa.Table:
        order, sums = np.argsort(table.column("part").to_numpy(), kind="stable"), table.column("sums")
        total = reduce(combine, (np.frombuffer(sums[int(k)].as_buffer(), np.float64) for k in order))
        return pa.table(row(table.column("part")[0].as_py() // MERGE, total))

    out, left = blocks.mapInArrow(run, schema), blocks.rdd.getNumPartitions()
    while left > MERGE:
        out = out.groupBy(F.floor(F.col("part") / MERGE).alias("g")).applyInArrow(merge, schema)
        left = -(-left // MERGE)
    rows = sorted(out.collect(), key=lambda r: r["part"])       # MERGE rows at most
    return reduce(combine, (np.frombuffer(bytes(r["sums"]), np.float64) for r in rows)) if rows else None


def java_doubles(spark, values: np.ndarray):
    """A Java array, sent as bytes in one piece."""
    buffer = spark._jvm.java.nio.ByteBuffer.wrap(bytearray(np.ascontiguousarray(values, ">f8").tobytes())).asDoubleBuffer()
    out = spark.sparkContext._gateway.new_array(spark._jvm.double, len(values))
    buffer.get(out)
    return out
