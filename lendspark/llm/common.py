"""Helpers shared by the operators: shared-folder staging, packed hash
partitions, and vectorized hashing of whole texts as UTF-8 bytes.

Packed rows. Operators that must shuffle one value per word or per byte
position do not send one Spark row for each: a task packs the values of each
hash partition into one binary cell, so a shuffled row carries thousands of
values and the JVM only moves bytes. The number of partitions grows with the
input (``packed_parts``), so one partition stays a bounded piece of work.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendspark.session import ensure_checkpoint_dir, shared_path

U64 = np.uint64
MIX = U64(0xD6E8FEB86659FD93)
RADIX = 0x9E3779B97F4A7C15          # odd: invertible modulo 2^64
SEGMENT = 1 << 18                    # bytes hashed at once


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return shared_path(spark, os.path.join("llm", f"{name}-{uuid.uuid4().hex}"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the
    lineage, survives lost executors, and later passes read only columns they
    need."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def packed_parts(rows: int, bytes_per_row: float, target: float = 8e6,
                 least: int = 12) -> int:
    """Hash partitions so that each holds about ``target`` bytes."""
    return max(least, math.ceil(rows * bytes_per_row / target))


def text_stats(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows, bytes of text) in one narrow pass."""
    r = docs.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.octet_length(text_col)).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer, in place."""
    h ^= h >> U64(32)
    h *= MIX
    h ^= h >> U64(32)
    h *= MIX
    h ^= h >> U64(29)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    a = np.full(n, base, dtype=U64)
    a[0] = 1
    return np.multiply.accumulate(a)


class ByteHash:
    """Hashes of substrings by prefix sums modulo 2^64: the hash of bytes
    [s, e) is (S[e] - S[s]) * RADIX^-s over table-randomized bytes, mixed."""

    def __init__(self, longest: int = SEGMENT, lower: bool = False, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2 ** 63, 256, dtype=U64) * U64(2) + U64(1)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.grow(longest)

    def grow(self, n: int) -> None:
        self.size = n
        self.pw = _powers(RADIX, n + 1)
        self.inv = _powers(pow(RADIX, -1, 2 ** 64), n + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > self.size:
            self.grow(n)
        s = np.empty(n + 1, U64)
        s[0] = 0
        np.cumsum(self.table[data] * self.pw[:n], out=s[1:])
        return s

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.inv[start])


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that are not ASCII white space."""
    word = ~SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(word)]))
    return edge[0::2], edge[1::2]


def text_groups(texts, limit: int = SEGMENT):
    """Group consecutive rows of an Arrow string column so that a group holds
    about ``limit`` bytes (a longer text is a group of its own). Yields (first
    row, bounds, data): row i of the group is data[bounds[i]:bounds[i + 1]],
    its UTF-8 bytes followed by one space that separates it from the next.
    Null texts are empty."""
    first, held, size = 0, [], 0
    for i in range(len(texts)):
        v = texts[i].as_buffer() if texts[i].is_valid else b""
        held.append(v)
        size += len(v) + 1
        if size >= limit:
            yield _group(first, held)
            first, held, size = i + 1, [], 0
    if held:
        yield _group(first, held)


def row_slices(batch, column: int = 0, limit: int = 8 << 20):
    """Slices of an Arrow batch that hold about ``limit`` bytes of text each, so that
    what a task derives from them stays bounded (a longer text is a slice alone)."""
    texts, start, size = batch.column(column), 0, 0
    for i in range(batch.num_rows):
        size += len(texts[i].as_buffer()) if texts[i].is_valid else 1
        if size >= limit:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _group(first: int, held: list) -> tuple[int, np.ndarray, np.ndarray]:
    bounds = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(v) + 1 for v in held], out=bounds[1:])
    data = np.frombuffer(b" ".join(held) + b" ", np.uint8)
    return first, bounds, data


class WordHash:
    """64-bit hashes of all words of a group of texts, A-Z lower-cased."""

    def __init__(self) -> None:
        self.hash = ByteHash(lower=True)

    def __call__(self, bounds: np.ndarray, data: np.ndarray):
        """(word hashes, index of each word's text, starts, ends)."""
        start, end = word_spans(data)
        h = self.hash.spans(self.hash.sums(data), start, end)
        return h, np.searchsorted(bounds, start, side="right") - 1, start, end


def split_parts(part: np.ndarray, n_parts: int, *columns: np.ndarray):
    """Yield (partition, column slices) of values dealt out by ``part``."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n_parts + 1))
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(cut[1:] > cut[:-1]):
        yield int(p), [c[cut[p]:cut[p + 1]] for c in columns]


def part_of(h: np.ndarray, n_parts: int) -> np.ndarray:
    """Partition of a 64-bit hash; mixed anew, since callers select by hash order, so
    that small hashes may be the common ones."""
    h = mix(h ^ U64(0xA0761D6478BD642F))
    return ((h >> U64(32)) * U64(n_parts) >> U64(32)).astype(np.int64)
