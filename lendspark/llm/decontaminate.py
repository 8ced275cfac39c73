"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as normalized bytes: ASCII letters lower-cased, every run of
other ASCII characters than letters and digits one space, a space at both ends.
An item of m bytes may be found with up to k = floor(rate * m) edits. It is split
into k + 1 pieces: k edits leave at least one piece untouched, so every match
holds an exact piece. All pieces are found at once by one Aho-Corasick automaton;
around the hits of an item, Myers' bit-parallel algorithm (one big integer as bit
vector) computes the least edit distance of the item to any part of the text.

The benchmark is a query set against all documents: it is sent to the tasks in
blocks of bounded size, one scan of the documents for each block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.llm.common import scratch
from lendspark.session import ensure_checkpoint_dir

RATE = 0.05               # edits allowed for each byte of an item
BLOCK_BYTES = 2_000_000   # benchmark text sent to the tasks at once

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def normalize(text: str) -> str:
    """Normalized UTF-8 bytes, one character for each; "" if nothing is left."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""


def myers(item_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the item to a substring of ``text``, its end)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = item_masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
            if not best:
                break
    return best, end


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick
        self.items, pieces = [], {}
        for key, text in items:
            t = normalize(text)
            if not t:
                continue
            m, n = len(t), len(self.items)
            k = int(rate * m)
            masks: dict[str, int] = {}
            for i, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << i
            self.items.append((key, t, k, masks))
            cut = [m * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cut, cut[1:]):
                pieces.setdefault(t[a:b], []).append((n, b))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def __call__(self, text: str, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item key, least distance, budget, places) of every item found; with
        ``first`` the search ends at the first item."""
        t = normalize(text)
        if not t or not self.any:
            return []
        begins: dict[int, list[int]] = {}
        for end, where in self.automaton.iter(t):
            for n, b in where:
                begins.setdefault(n, []).append(end + 1 - b)
        out = []
        for n, at in begins.items():
            key, item, k, masks = self.items[n]
            m = len(item)
            at.sort()
            best, places, i = k + 1, 0, 0
            while i < len(at):              # hits that can belong to one match
                j = i
                while j + 1 < len(at) and at[j + 1] - at[j] <= 2 * k:
                    j += 1
                lo, hi = max(0, at[i] - k), at[j] + m + k
                if any(t.startswith(item, a) for a in {at[i], at[j]} if a >= 0):
                    d = 0
                else:
                    d = myers(masks, m, t[lo:hi])[0]
                if d <= k:
                    best, places = min(best, d), places + 1
                i = j + 1
            if places:
                out.append((key, best, k, places))
                if first:
                    break
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Blocks of (item, text) lists, of bounded expected size."""
    items = (benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
             .where("i IS NOT NULL AND t IS NOT NULL"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()   # bounded block
        yield sorted({(r["i"], r["t"]) for r in rows})


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id",
               item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: (id, item, edits, budget, places).

    Null, empty and wordless texts and items match nothing; items with a null id
    are not used; an item id with several texts gives a row for each that is
    found. Null document ids and repeated rows are kept. Whole texts are searched.
    Other columns are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` long, edits long, budget long, places long"
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    path = scratch(spark, "leaks")
    for items in _blocks(benchmark, item_col, text_col):
        def search(batches, items=items):
            match = Matcher(items, rate)
            for b in batches:
                row, found = [], []
                for i, v in enumerate(b.column(1)):
                    for hit in match(v.as_py() or ""):
                        row.append(i)
                        found.append(hit)
                cols = np.array(found, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), *[pa.array(cols[:, c]) for c in range(4)]],
                    names=[id_col, item_col, "edits", "budget", "places"])
        source.mapInArrow(search, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no benchmark item, all columns unchanged."""
    ensure_checkpoint_dir(docs.sparkSession)
    at = docs.columns.index("text")
    for items in _blocks(benchmark, "item_id", "text"):
        def keep(batches, items=items):
            match = Matcher(items, rate)
            for b in batches:
                yield b.filter(pa.array([not match(v.as_py() or "", first=True) for v in b.column(at)],
                                        pa.bool_()))
        docs = docs.mapInArrow(keep, docs.schema)
    return docs
