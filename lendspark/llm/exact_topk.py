"""Exact top-k inner-product search by term-at-a-time accumulation.

Vectors are integer weights floor(scale * x); a component is a term, and a block
of candidates keeps for each term its postings (row, weight) without zeros. For
a block of queries the terms are taken one after another: the queries' weights
of the term times its postings are scattered into a dense score array (candidate
x query). Then a partition selection keeps each query's k best, merged over the
blocks of a task and at the end over all tasks. Selection looks at scores alone; among equal
scores at the border the smaller ids stay. Products that 64-bit sums may not hold are
accumulated as Python integers, so scores are exact for any finite component; a score
that no long can hold ends the query with an error if it belongs to the result.

Every query meets every candidate; queries come in blocks of bounded size
(``QUERY_BLOCK`` expected rows), each sent to the tasks that scan the candidates, which
are written once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendspark.llm.common import scratch, staged
from lendspark.session import ensure_checkpoint_dir

QUERY_BLOCK = 32_768      # queries sent to the tasks at once (64 components: 8 MB)
CAND_CHUNK, QUERY_CHUNK = 2048, 256
MOST = 2 ** 63 - 1        # scores of this size or more are marked and refused
NONE = np.iinfo(np.int64).min


def dense_rows(column: pa.Array, scale: float) -> np.ndarray:
    """(rows, longest length) integer weights; missing components are 0. Python
    integers where a weight has 62 bits or more."""
    n = len(column)
    if not n:
        return np.zeros((0, 0), np.int64)
    off = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.diff(off)
    w = np.floor(flat[off[0]:off[-1]] * scale)
    if np.abs(w).max(initial=0) < 2.0 ** 62:
        w = w.astype(np.int64)
    else:
        w = np.array([int(x) for x in w.tolist()], dtype=object)
    out = np.zeros((n, int(length.max())), w.dtype)
    row = np.repeat(np.arange(n), length)
    out[row, np.arange(len(w)) - np.repeat(off[:-1] - off[0], length)] = w
    return out


def accumulate(cand: np.ndarray, query: np.ndarray, kind) -> np.ndarray:
    """Score array (candidates, queries), one term after another."""
    score = np.zeros((len(cand), len(query)), kind)
    for t in range(min(cand.shape[1], query.shape[1])):
        q = query[:, t]
        cols = np.flatnonzero(q)
        if not len(cols):
            continue
        rows = np.flatnonzero(cand[:, t])
        if 2 * len(rows) > len(cand):     # a dense posting list: all rows, zeros add nothing
            score += np.multiply.outer(cand[:, t], q)
        elif len(rows):
            score[rows] += np.multiply.outer(cand[rows, t], q)
    return score


def top_k(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id",
          vec_col: str = "embedding", scale: float = 64.0,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) for every id that ``is_query``
    (a Column over the id column) selects, against all other rows.

    Rows with a null id, a null vector, or a null, NaN or infinite component take
    no part. Shorter vectors count as padded with zeros; empty ones score 0. Of
    repeated query ids the smallest vector is the query; all rows with the query's
    id are its own and no candidates; repeated candidates each take a rank. Ties go
    to the smaller id. Scores of 2^63 - 1 or more in size are refused with an error if
    they are among the results. Fewer than k candidates: all of them. Other columns are
    not read.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    x = F.col(vec_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = (df.where(F.col(id_col).isNotNull() & x.isNotNull() & whole)
            .select(F.col(id_col).cast("long").alias("i"), x.alias("v")))
    queries = df.select(F.col(id_col)).where(is_query & F.col(id_col).isNotNull())
    n_blocks = max(1, math.ceil(queries.count() / query_block))
    q_rows = (df.where(is_query).where(F.col(id_col).isNotNull() & x.isNotNull() & whole)
              .select(F.col(id_col).cast("long").alias("i"), x.cast("array<double>").alias("v"))
              .groupBy("i").agg(F.min("v").alias("v"))
              .withColumn("b", F.pmod(F.xxhash64("i"), F.lit(n_blocks))))
    rows = staged(rows.repartition(spark.sparkContext.defaultParallelism * 3), "topk-rows").select(
        "i", F.col("v").cast("array<double>").alias("v"))
    found = scratch(spark, "topk")
    for b in range(n_blocks):
        held = q_rows.where(F.col("b") == b).select("i", "v").orderBy("i").toArrow()
        ids = held.column(0).to_numpy()
        vec = dense_rows(held.column(1).combine_chunks() if len(ids) else pa.array([], pa.list_(pa.float64())), scale)
        sent = spark.sparkContext.broadcast((ids, vec))
        (rows.mapInArrow(_scan(sent, k, scale),
                                             "query_id long, vec_id long, score long")
         .write.mode("append").parquet(found))
        sent.destroy()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (spark.read.schema("query_id long, vec_id long, score long").parquet(found)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id",
                    F.when(F.abs("score") < MOST, F.col("score")).otherwise(
                        F.raise_error(F.lit("a score does not fit a long"))).alias("score")))


def _scan(sent, k: int, scale: float):
    def scan(batches):
        q_ids, q_vec = sent.value
        if not len(q_ids):
            return
        q_most = _largest(q_vec)
        score = np.full((len(q_ids), 0), NONE, np.int64)
        ids = np.full((len(q_ids), 0), 0, np.int64)
        for b in batches:
            b_ids, b_vec = b.column(0).to_numpy(), dense_rows(b.column(1), scale)
            order = np.argsort(b_ids, kind="stable")
            b_ids, b_vec = b_ids[order], b_vec[order]
            got = [[], []]
            for c in range(0, len(b_ids), CAND_CHUNK):
                c_ids, c_vec = b_ids[c:c + CAND_CHUNK], b_vec[c:c + CAND_CHUNK]
                bound = q_most * _largest(c_vec) * max(1, b_vec.shape[1])
                kind = np.int32 if bound < 2 ** 31 else np.int64 if bound < 2 ** 62 else object
                c_vec = np.ascontiguousarray(c_vec).astype(kind)
                s_all, i_all = [], []
                for q in range(0, len(q_ids), QUERY_CHUNK):
                    s = accumulate(c_vec, q_vec[q:q + QUERY_CHUNK].astype(kind), kind).T
                    s = (np.clip(s, -MOST, MOST) if kind is object else s).astype(np.int64)
                    own = q_ids[q:q + QUERY_CHUNK]
                    lo, hi = np.searchsorted(c_ids, own), np.searchsorted(c_ids, own, side="right")
                    for r in np.flatnonzero(hi > lo):
                        s[r, lo[r]:hi[r]] = NONE
                    s, at = select(s, k)
                    s_all.append(s)
                    i_all.append(np.where(s == NONE, 0, c_ids[at]))
                got[0].append(np.concatenate(s_all))
                got[1].append(np.concatenate(i_all))
            if got[0]:
                score, ids = _best(np.concatenate([score, *got[0]], 1),
                                   np.concatenate([ids, *got[1]], 1), k)
        keep = score != NONE
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, keep.sum(1))), pa.array(ids[keep]), pa.array(score[keep])],
                names=["query_id", "vec_id", "score"])
    return scan


def _largest(weights: np.ndarray) -> int:
    return max(int(weights.max()), -int(weights.min())) if weights.size else 0


def select(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise the k highest scores and their columns; of equal scores at the border the
    first columns stay."""
    n = score.shape[1]
    if n <= k:
        return score, np.broadcast_to(np.arange(n), score.shape)
    border = np.partition(score, n - k, axis=1)[:, n - k:n - k + 1]
    above, equal = score > border, score == border
    room = k - above.sum(1, keepdims=True)
    keep = above | (equal & (np.cumsum(equal, axis=1) <= room))
    at = np.nonzero(keep)[1].reshape(len(score), k)
    return np.take_along_axis(score, at, 1), at


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise the k highest scores, ties to the smaller id."""
    order = np.lexsort((-ids, score), axis=-1)[:, -k:]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
