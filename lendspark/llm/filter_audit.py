"""What each filter of a chain does, in every order of the chain.

A row's failures are a mask with one bit a filter, so all counts of all orders
follow from the number of rows of each (part, mask): Spark counts masks once, and the
orders are sums over at most 2^k counts of a part.

One filter fails a text that a smaller id has too. A counting-Bloom prepass keeps most
texts out of its shuffle: every task counts the cells of its texts' hashes, the
sketches are merged cell by cell, and a text with a cell that only it hit is unique for
sure. Only texts whose cells were all hit at least twice are grouped, by the whole
text, for the smallest id. The sketch has ``CELLS_PER_ROW`` cells a row, as bits of
which ``MAX_CELLS`` at most are sent to the tasks (32 MB); in a table beyond that
size more texts are taken for possible repeats, which costs work and changes nothing
in the result.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendspark.llm.common import U64, mix, split_parts, staged
from lendspark.session import ensure_checkpoint_dir

CELLS_PER_ROW = 8
MAX_CELLS = 1 << 28
SEGMENT_CELLS = 1 << 20
HASHES = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
WORD = r"[^\x20\x09-\x0D]+"


def cells_of(h: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cells of text hashes, one array for each hash function."""
    h = h.astype(np.int64).view(U64)
    return [(mix(h * k) & U64(cells - 1)).astype(np.int64) for k in HASHES]


def _sketch(cells: int, segment: int, flush: int = 1 << 20):
    """Cell counts (0, 1, 2 or more) of one task's text hashes, packed by segment."""
    def packed(h: np.ndarray) -> pa.RecordBatch:
        cell, count = np.unique(np.concatenate(cells_of(h, cells)), return_counts=True)
        out = [(s, (c % segment).astype(np.uint32).tobytes(), n.tobytes()) for s, (c, n) in
               split_parts(cell // segment, cells // segment, cell, np.minimum(count, 2).astype(np.uint8))]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32())] +
            [pa.array([r[i] for r in out], pa.binary()) for i in (1, 2)], names=["seg", "cell", "count"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            rows += b.num_rows
            if rows >= flush:
                yield packed(np.concatenate(held))
                held, rows = [], 0
        if rows:
            yield packed(np.concatenate(held))
    return run


def _merge(segment: int):
    """One segment's sketches added up: the bits of cells hit at least twice."""
    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(segment, np.uint8)
        for cell, count in zip(table.column("cell"), table.column("count")):
            at = np.frombuffer(cell.as_buffer(), np.uint32)
            total[at] = np.minimum(total[at] + np.frombuffer(count.as_buffer(), np.uint8), 2)
        return pa.table({"seg": table.column("seg").slice(0, 1),
                         "bits": pa.array([np.packbits(total == 2).tobytes()], pa.binary())})
    return run


def repeat_sketch(hashes: DataFrame, rows: int) -> np.ndarray:
    """Bits of the counting Bloom filter of a column of text hashes whose cells were hit
    at least twice."""
    cells = min(MAX_CELLS, max(SEGMENT_CELLS, 1 << max(0, CELLS_PER_ROW * rows - 1).bit_length()))
    segment = min(SEGMENT_CELLS, cells)
    merged = (hashes.mapInArrow(_sketch(cells, segment), "seg int, cell binary, count binary")
              .groupBy("seg").applyInArrow(_merge(segment), "seg int, bits binary").toArrow())  # MAX_CELLS / 8 bytes at most
    bits = np.zeros(cells // 8, np.uint8)
    for seg, b in zip(merged.column("seg").to_pylist(), merged.column("bits")):
        part = np.frombuffer(b.as_buffer(), np.uint8)
        bits[seg * len(part):(seg + 1) * len(part)] = part
    return bits


def may_repeat(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether all cells of each hash were hit at least twice."""
    cells = cells_of(h, 8 * len(bits))
    return np.logical_and.reduce([(bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1 for c in cells])


def text_conditions() -> dict[str, Column]:
    """The filters that judge a text alone, by letter: columns over ``t`` (text) and ``w``
    (its words) that are true where the text fails."""
    return {"A": F.size("w") < 50,
            "B": 100 * F.size(F.array_distinct("w")) < 65 * F.size("w"),
            "C": 100 * F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long") > 5 * F.length("t").cast("long"),
            "D": F.col("t").rlike("[#$%&*|]")}


def failure_masks(docs: DataFrame, conditions: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "source") -> DataFrame:
    """(id, part, mask): bit k of ``mask`` says that the row fails condition k; the bit
    after them that a smaller id has the same text. A null text is empty, a null part
    the empty string. A null id is smaller than none and none is smaller than it."""
    ensure_checkpoint_dir(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    mark = lambda: [F.xxhash64("t").alias("h"), F.crc32(F.col("t").cast("binary")).alias("c"),
                    F.octet_length("t").alias("size")]
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
                                                for k, c in enumerate(conditions.values())], F.lit(0))
    rows = staged(base.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
                  .select("id", "part", mask.cast("int").alias("mask"), *mark()), "audit-rows")
    sent = docs.sparkSession.sparkContext.broadcast(repeat_sketch(rows.select("h"), rows.count()))

    @F.pandas_udf("boolean")
    def suspect(h: pd.Series) -> pd.Series:
        return pd.Series(may_repeat(h.to_numpy(), sent.value))

    firsts = staged(base.select("id", "t", *mark()).where(F.col("id").isNotNull() & suspect("h"))
                    .groupBy("t").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("h", "c", "size")])
                    .drop("t").distinct(), "audit-firsts")
    bit = 1 << len(conditions)
    found = (rows.where(F.col("id").isNotNull()).withColumn("suspect", suspect("h"))
             .join(firsts.withColumn("first", F.lit(True)), ["id", "h", "c", "size"], "left")
             .withColumn("mask", F.when(F.col("suspect") & F.col("first").isNull(),
                                        F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask"))))
    return found.select("id", "part", "mask").unionByName(
        rows.where(F.col("id").isNull()).select("id", "part", "mask"))


def order_counts(masks: DataFrame, letters: str) -> DataFrame:
    """All orders of the filters from counts (part, mask, n, good, toxic): one row a part,
    order and step."""
    k = len(letters)
    steps = [{"filter_order": "".join(letters[i] for i in p), "step": s + 1,
              "before": sum(1 << i for i in p[:s]), "bit": 1 << p[s]}
             for p in permutations(range(k)) for s in range(k)]
    wide = masks.groupBy("part").agg(*[
        F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(F.lit(0).cast("long")))
                  for m in range(1 << k)]).alias(c) for c in ("n", "good", "toxic")])
    rows = wide.withColumn("s", F.explode(F.from_json(
        F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,bit:int>>")))
    every = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    before, bit = F.col("s.before"), F.col("s.bit")

    def over(counts: str, of, weight=None) -> Column:
        def add(total, m):
            n = F.element_at(F.col(counts), m + 1)
            return total + F.when(of(m), n * weight(m) if weight else n).otherwise(F.lit(0).cast("long"))
        return F.aggregate(every, F.lit(0).cast("long"), add)

    fails = lambda m: m.bitwiseAND(bit) != 0                                     # noqa: E731
    gone = lambda m: m.bitwiseAND(before) != 0                                   # noqa: E731
    share = lambda m: (F.lit(len(steps) // k) / F.bit_count(m)).cast("long")     # noqa: E731
    return rows.select(
        "part", F.col("s.filter_order").alias("filter_order"), F.col("s.step").alias("step"),
        over("n", lambda m: ~gone(m) & ~fails(m)).alias("kept"),
        over("n", lambda m: ~gone(m) & fails(m)).alias("removed"),
        over("n", lambda m: gone(m) & fails(m)).alias("redundant"),
        over("n", lambda m: m == bit).alias("unique_fails"),
        over("good", lambda m: ~gone(m) & fails(m)).alias("good_lost"),
        over("toxic", lambda m: ~gone(m) & fails(m)).alias("toxic_lost"),
        over("n", fails, share).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None, id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts of every order of the filters, per part: (part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    The filters are ``conditions`` (default: ``text_conditions()``) and, under the next
    letter, the repeats of a text with a smaller id, table-wide. ``shapley`` is the number
    of rows a filter removes, summed over all orders (a row that fails j filters is
    removed by each of them in an equal share of the orders). A document is good or toxic
    where any of its rows in ``labels`` says 1; documents without one are neither, labels
    without a document are not used. Null texts are empty, and so is a null part; rows
    with a null id are counted, never as repeats. Repeated rows (equal id and text) are
    counted each and are no repeats of one another. Whole texts of any length. Other
    columns, of any name, are not read. An empty table gives no rows.
    """
    conditions = conditions or text_conditions()
    letters = "".join(conditions) + chr(ord(max(conditions)) + 1)
    kind = (labels.select(F.col(id_col).alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id")
            .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                 F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    masks = (failure_masks(docs, conditions, id_col, text_col, part_col).join(kind, "id", "left")
             .groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"),
                                          F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
                                          F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")))
    return order_counts(masks, letters)
