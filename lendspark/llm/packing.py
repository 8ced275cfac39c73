"""Packing token sequences into fixed windows by non-negative least squares.

Each document's ids are cut at multiples of the window; the pieces' lengths,
rounded up to units of 16 tokens, give a histogram of at most 256 bins. All
shallow combinations (up to three lengths) that fill a window exactly are the
columns of a matrix; non-negative least squares finds how often to repeat each so
that the histogram is used up. Counts are rounded within what is there, and the
residual is packed greedily by descending length, on counts, not on documents.
Greedy patterns that would leave more than 3 % of a window empty are dissolved:
their pieces are laid end to end and cut at a 64-token grid where a window ends.

The driver sees the histogram only. A piece finds its place from its rank inside
its length bin, a two-level prefix count (hash part, then inside the part).
Tokenizing happens once; a piece carries the CRCs of its grid prefixes, from which
that of any later part follows, so a cut needs no second look at the text.
"""

from __future__ import annotations

import math
import re
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendspark.llm.common import staged
from lendspark.session import ensure_checkpoint_dir

UNIT = 16             # tokens; lengths are rounded up to it for planning
GRID = 64             # tokens; where residual pieces may be cut
GOOD_FILL = 0.97      # residual patterns below are dissolved and cut
PART_ROWS = 50_000    # pieces ranked in one window
CACHE_WORDS = 500_000  # words whose ids a worker keeps

# The text steps of the tokenizer file, under which ids of words
# that ASCII white space separates do not depend on their neighbours.
SPLIT_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPACES = "[ \t\n\x0b\x0c\r]"


class DocumentIds:
    """Little-endian unsigned 32-bit ids of a text, by a tokenizer file's JSON.

    When the file splits text as ``SPLIT_PATTERN`` does, ids are looked up by
    word: a cache of words, under it one of lower-cased letter runs, and the
    tokenizer itself for the rest. Any other file encodes whole texts."""

    def __init__(self, tokenizer_json: str) -> None:
        import json

        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (steps[0].get("pattern", {}).get("Regex") == SPLIT_PATTERN
                        and normal == ["NFC", "Replace", "Lowercase"])
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words = _Cache(self._word)
        self.runs = _Cache(self._run)
        self.marks = _Cache(self._plain)

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        return self._pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _run(self, run: str) -> bytes:
        """Ids of a run of letters."""
        if run.isascii():
            symbols = run
        else:
            normal = self.tok.normalizer.normalize_str(run)
            if not normal.isalpha():
                return self._plain(run)
            symbols = self.bytes_of.pre_tokenize_str(normal)[0][0]
        return self._pack([t.id for t in self.tok.model.tokenize(symbols)])

    def _word(self, word: str) -> bytes:
        core = word.rstrip(string.punctuation)
        if core.isalpha():
            run = self.runs[core.lower() if core.isascii() else core]
            return run if len(core) == len(word) else run + self.marks[word[len(core):]]
        return self._plain(word)

    def __call__(self, text: str) -> bytes:
        if not self.by_word:
            return self._plain(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):     # no white space to the tokenizer
            words = filter(None, re.split(SPACES, text))
        else:
            words = text.split()
        return b"".join(map(self.words.__getitem__, words))


class _Cache(dict):
    """Values by key, computed once; starts anew when it is full."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _square(m: list[int]) -> list[int]:
    return [_times(m, x) for x in m]


def _times(m: list[int], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= m[i]
        v >>= 1
        i += 1
    return out


def crc_of_tail(whole: int, head: int, tail_bytes: int) -> int:
    """CRC-32 of B from those of AB and A: appending bytes is a linear map over
    GF(2), so crc(AB) = shift(crc(A), len(B)) xor crc(B)."""
    op = _square(_square(_square([0xEDB88320] + [1 << i for i in range(31)])))   # one byte
    while tail_bytes:
        if tail_bytes & 1:
            head = _times(op, head)
        tail_bytes >>= 1
        if tail_bytes:
            op = _square(op)
    return whole ^ head


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, heads array<long>"


def document_pieces(docs: DataFrame, tokenizer_json: str, window: int, end_id: int,
                    id_col: str, text_col: str) -> DataFrame:
    """One row per window-sized piece and remainder of every document, with the
    CRCs of the remainder's grid prefixes."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)   # one vocabulary file
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches):
        ids_of = DocumentIds(sent.value)
        for b in batches:
            rows = [[] for _ in range(6)]
            for key, v in zip(b.column(0).to_pylist(), b.column(1)):
                ids = ids_of(v.as_py() or "") + end
                n = len(ids) // 4
                for s in range(0, n, window):
                    piece = ids[4 * s:4 * (s + window)]
                    length = len(piece) // 4
                    at = range(4 * GRID, len(piece), 4 * GRID) if length < window else ()
                    head, heads = 0, []
                    for k in at:
                        head = zlib.crc32(piece[k - 4 * GRID:k], head)
                        heads.append(head)
                    head = zlib.crc32(piece[4 * GRID * len(heads):], head)
                    for col, x in zip(rows, (key, s, length, head, n, heads)):
                        col.append(x)
            types = [b.schema.types[0], *[pa.int64()] * 4, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)],
                                             names=[id_col, "start", "length", "ids_crc32",
                                                    "doc_tokens", "heads"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col), F.col(text_col).cast("string"))
            .mapInArrow(cut, f"`{id_col}` {kind}, {PIECES}"))


def combinations(units: int) -> np.ndarray:
    """Columns: how often each length 1..units occurs in the combinations of one
    to three lengths that sum to ``units``."""
    cols = []
    for i in range(1, units + 1):
        if i == units:
            cols.append((i,))
        for j in range(i, units - i + 1):
            if i + j == units:
                cols.append((i, j))
            elif units - i - j >= j:
                cols.append((i, j, units - i - j))
    a = np.zeros((units, len(cols)))
    for c, lengths in enumerate(cols):
        for length in lengths:
            a[length - 1, c] += 1
    return a


def nnls(a: np.ndarray, h: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """argmin |a x - h| over x >= 0, by active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (h - a @ x)
        gain[passive] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tol:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            sub = a[:, at]
            gram = sub.T @ sub
            gram.flat[::len(at) + 1] += 1e-10        # lets dependent columns pass
            z = np.linalg.solve(gram, sub.T @ h)
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300))
            x[at] += step * (z - x[at])
            passive[at[x[at] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(hist: np.ndarray, units: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Patterns ({length in units: times}, repeats) and, by length, how many pieces
    are left to be laid end to end. ``hist[u]``: pieces of u units."""
    left = hist.astype(np.int64).copy()
    patterns: list[tuple[dict[int, int], int]] = []
    if left[units]:
        patterns.append(({units: 1}, int(left[units])))
        left[units] = 0
    if left.sum():
        a = combinations(units)
        h = left[1:].astype(float)
        x = nnls(a, h / h.sum()) * h.sum()
        for c in np.argsort(-x, kind="stable"):
            times = int(round(x[c]))
            if times <= 0:
                break
            lengths = {int(u) + 1: int(a[u, c]) for u in np.flatnonzero(a[:, c])}
            times = min([times, *(int(left[u]) // m for u, m in lengths.items())])
            if times > 0:
                patterns.append((lengths, times))
                for u, m in lengths.items():
                    left[u] -= m * times
    line = np.zeros_like(left)
    while left.sum():
        lengths, room, free = {}, units, left.copy()
        for u in range(units, 0, -1):
            m = int(min(free[u], room // u))
            if m:
                lengths[u] = m
                room -= m * u
        times = min(int(left[u]) // m for u, m in lengths.items())
        for u, m in lengths.items():
            left[u] -= m * times
        if room <= (1 - GOOD_FILL) * units:
            patterns.append((lengths, times))
        else:
            for u, m in lengths.items():
                line[u] += m * times
    return patterns, line


def _places(patterns, line: np.ndarray, units: int) -> dict[str, np.ndarray]:
    """Rank intervals of each length: sorted keys length * 2^44 + first rank, and
    where the pieces of the interval go."""
    used: dict[int, int] = {}
    rows, seq = [], 0
    for lengths, times in patterns:
        slot = 0
        for u in sorted(lengths, reverse=True):
            rows.append((u, used.get(u, 0), 0, seq, lengths[u], slot, 0))
            used[u] = used.get(u, 0) + lengths[u] * times
            slot += lengths[u]
        seq += times
    at = 0
    for u in range(units, 0, -1):
        if line[u]:
            rows.append((u, used.get(u, 0), 1, seq, 1, 0, at))
            at += u * int(line[u])
    rows.sort()
    names = ("units", "first", "line", "seq", "times", "slot", "at")
    out = {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}
    out["key"] = (out["units"] << 44) + out["first"]
    return out


def _placer(places: dict[str, np.ndarray], units: int, id_col: str):
    """Ranked pieces to placed pieces; one that crosses a window of the line is
    cut at the grid, or goes whole to one side."""
    room = units - (GRID // UNIT - 1)       # the line's share of a window

    def place(batches):
        for b in batches:
            c = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)
                 if n in ("start", "length", "ids_crc32", "doc_tokens", "u", "rank")}
            k = np.searchsorted(places["key"], (c["u"] << 44) + c["rank"], side="right") - 1
            nth = c["rank"] - places["first"][k]
            times = places["times"][k]
            on_line = places["line"][k] == 1
            pos = places["at"][k] + nth * c["u"]
            seq = places["seq"][k] + np.where(on_line, pos // room, nth // times)
            slot = np.where(on_line, pos % room + 1, places["slot"][k] + nth % times)
            before = room - pos % room
            cut = np.where(on_line & (before < c["u"]), before * UNIT // GRID * GRID, c["length"])
            cut = np.minimum(cut, c["length"])
            whole_next = cut == 0
            seq, slot = seq + whole_next, np.where(whole_next, 0, slot)
            cut = np.where(whole_next, c["length"], cut)
            two = np.flatnonzero(cut < c["length"])
            grid = cut[two] // GRID - 1
            heads = b.column(b.schema.names.index("heads"))
            crc, rest = c["ids_crc32"].copy(), []
            for i, g in zip(two.tolist(), grid.tolist()):
                crc[i] = heads[i].as_py()[g]
                rest.append(crc_of_tail(int(c["ids_crc32"][i]), int(crc[i]), 4 * int(c["length"][i] - cut[i])))
            key = b.column(0)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([key, key.take(pa.array(two))]),
                 pa.array(np.concatenate([c["start"], c["start"][two] + cut[two]])),
                 pa.array(np.concatenate([cut, c["length"][two] - cut[two]])),
                 pa.array(np.concatenate([crc, np.array(rest, np.int64)])),
                 pa.array(np.concatenate([c["doc_tokens"], c["doc_tokens"][two]])),
                 pa.array(np.concatenate([seq, seq[two] + 1])),
                 pa.array(np.concatenate([slot, np.zeros(len(two), np.int64)]))],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])
    return place


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset). Every id of every document, with ``end_id`` after its last, lies in
    exactly one piece; sequences hold at most ``window`` ids without gaps.

    A null or empty text is the end id alone. Null ids and repeated rows are
    documents of their own. Long texts give as many pieces as they need. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    units = window // UNIT
    tokenizer_json = "".join(r[0] for r in spark.read.text(_uri(tokenizer_path), wholetext=True).collect())
    pieces = staged(document_pieces(docs, tokenizer_json, window, end_id, id_col, text_col)
                    .withColumn("u", F.ceil(F.col("length") / UNIT).cast("long")), "pack-pieces")
    counts = pieces.groupBy("u").count().collect()                  # at most 256 rows
    hist = np.zeros(units + 1, np.int64)
    for r in counts:
        hist[r["u"]] = r["count"]
    patterns, line = plan(hist, units)
    places = _places(patterns, line, units)

    parts = max(1, math.ceil(int(hist.max()) / PART_ROWS))
    part = F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(parts)).cast("int")
    keyed = pieces.withColumn("p", part)
    cells = keyed.groupBy("u", "p").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("u").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("u", "p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("o"))
    inside = Window.partitionBy("u", "p").orderBy(id_col, "start", "ids_crc32")
    ranked = (keyed.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["u", "p"])
              .select(id_col, "start", "length", "ids_crc32", "doc_tokens", "heads", "u",
                      (F.col("o") + F.col("r")).cast("long").alias("rank")))
    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked.mapInArrow(
        _placer(places, units, id_col), f"`{id_col}` {kind}, start long, length long, "
        "ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    w = (Window.partitionBy("sequence_id").orderBy("slot", id_col, "start")
         .rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"))


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path
