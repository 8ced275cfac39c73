"""Removal of repeated byte strings by suffix arrays, over a corpus that no task
can hold.

A string of ``length`` bytes is repeated when it starts at two places. Its anchor
is the q-byte gram with the smallest hash inside it, so equal strings have equal
anchors at equal offsets, and every string start belongs to one anchor
occurrence. Shuffling by anchor brings together all strings that can be equal:

1. Each text gives its anchor occurrences, with a hash of all bytes that the
   strings of the occurrence cover. Equal ones repeat each other; an anchor with
   one occurrence repeats nothing. Only occurrences of one anchor that differ
   need a look at their bytes.
2. Their contexts are sorted: the bytes from the anchor on, as blocks, form one
   symbol string, whose suffix array is built by linear grouping
   (``suffix_sort``). Common prefixes of neighbours give, for every start x bytes
   left of the anchor, which contexts agree on the rest of the string; those that
   also agree on the x bytes are repeats.
3. Starts of repeats become byte runs of their text, which is cut accordingly.

A text is named by its 64-bit hash, and texts that are equal share their runs; a task
sends the anchors of at most two copies. An anchor with ``HOT`` occurrences or more is no
group of one task. Occurrences are counted beforehand: slices send the counts of
``FEW`` and more, and a hash sample of the smaller ones with weights, so that an anchor
thinly spread over many slices is found as well. The limit rises with the corpus so
slowly (``HOT_MOST``) that the hot hashes, sent to all tasks, have a bounded size. A hot
anchor's occurrences are dealt by context, those of a hot context, which are repeats for
sure, by place; and its different contexts are not sorted, but the hashes of their
strings are counted by Spark, whose sums and joins split a hot key.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.llm.common import (U64, ByteHash, mix, packed_parts, part_of, row_slices, split_parts, staged,
                                  text_groups, text_stats)
from lendspark.llm.suffix_sort import suffix_order
from lendspark.session import ensure_checkpoint_dir

GRAM = 64                 # bytes of an anchor
BLOCK = 50                # bytes of one symbol of the sorted string
HOT = 8192                # occurrences from which an anchor or a context is split
FEW = 8                   # smaller counts of a slice are sampled
SEEN = 32                 # samples expected of an anchor at the limit
HOT_MOST = 1 << 20        # hot anchors, and contexts, at most (8 MB of hashes)
HASHES = 200_000          # string hashes sent at once


def _sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    m, k = key, 1
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if k < w:
        m = np.minimum(m[:-(w - k)], m[w - k:])
    return m


class Anchors:
    """Anchor occurrences of texts: every string start belongs to one."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram, self.hash = length, gram, ByteHash(seed=23)

    def __call__(self, bounds: np.ndarray, data: np.ndarray):
        """(anchor hash, context hash, text index, anchor position in the text,
        first and last string start, as distances left of the anchor)."""
        n, w = len(data), self.length - self.gram + 1
        if n < self.length:
            return [np.zeros(0, U64)] * 2 + [np.zeros(0, np.int64)] * 4
        sums = self.hash.sums(data)
        at = np.arange(n - self.gram + 1)
        h = self.hash.spans(sums, at, at + self.gram)
        bits = U64(max(21, int(n).bit_length()))
        key = (h >> bits << bits) | at.astype(U64)
        first = (_sliding_min(key, w) & ((U64(1) << bits) - U64(1))).astype(np.int64)
        text = np.searchsorted(bounds, np.arange(len(first)), side="right") - 1
        ok = np.arange(len(first)) + self.length <= bounds[text + 1] - 1   # not the separator
        start = np.flatnonzero(ok)
        first, text = first[start], text[start]
        if not len(start):
            return [np.zeros(0, U64)] * 2 + [np.zeros(0, np.int64)] * 4
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (text[1:] != text[:-1])))
        lo = np.flatnonzero(new)
        hi = np.concatenate((lo[1:], [len(start)])) - 1
        p, s0, s1, t = first[lo], start[lo], start[hi], text[lo]
        context = self.hash.spans(sums, s0, s1 + self.length)
        context = mix(context + (p - s0).astype(U64) * U64(0x9E3779B97F4A7C15) + (s1 - s0).astype(U64))
        return [h[p], context, t, p - bounds[t], p - s0, p - s1]


FIELDS = (("anchor", U64), ("context", U64), ("text", np.int64), ("pos", np.int32),
          ("far", np.uint16), ("near", np.uint16))


def _occurrences(length: int, gram: int, batches):
    """Anchor occurrences of each slice of a task's texts, at most two copies of a text."""
    anchors, copies = Anchors(length, gram), Counter()
    for b in (part for whole in batches for part in row_slices(whole, 1)):
        ref = b.column(0).to_numpy()
        copies.update(ref.tolist())
        if any(copies[r] > 2 for r in ref.tolist()):
            copies.subtract(ref.tolist())
            keep = []
            for r in ref.tolist():
                copies[r] += 1
                keep.append(copies[r] <= 2)
            b = b.filter(pa.array(keep))
            ref = b.column(0).to_numpy()
        if not b.num_rows:
            continue
        cols = []
        for first, bounds, data in text_groups(b.column(1)):
            c = anchors(bounds, data)
            c[2] = ref[first + c[2]]
            cols.append(c)
        yield [np.concatenate([c[i] for c in cols]).astype(t) for i, (_, t) in enumerate(FIELDS)]


def _crowded(length: int, gram: int, least: int, one_in: int):
    """(kind, hash, n) of the anchors (0) and contexts (1) of a slice: counts of ``least`` and
    more, and of the others one in ``one_in``, that many times its count."""
    def crowded(batches):
        for cols in _occurrences(length, gram, batches):
            salt = mix(np.bitwise_xor.reduce(cols[2]).astype(np.int64).reshape(1).view(U64).copy()) if len(cols[2]) else U64(0)
            for kind in range(2):
                h, n = np.unique(cols[kind], return_counts=True)
                few = n < least
                drawn = mix(h ^ salt) % U64(one_in) == 0
                n = np.where(few, n * one_in, n)
                keep = drawn | ~few
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(keep.sum()), kind, np.int32)), pa.array(h[keep].view(np.int64)), pa.array(n[keep])],
                    names=["kind", "hash", "n"])
    return crowded


def hot_hashes(texts: DataFrame, length: int, gram: int, size: int) -> list[np.ndarray]:
    """Hashes of the anchors, and of the contexts, with about the limit of occurrences or
    more, by estimate: sorted, ``HOT_MOST`` of each at most in expectation."""
    limit = max(HOT, 2 * math.ceil(size / ((length - gram + 2) / 2)) // HOT_MOST)
    one_in = max(1, limit // FEW // SEEN)
    rows = (texts.select("text", "t").mapInArrow(_crowded(length, gram, FEW, one_in), "kind int, hash long, n long")
            .groupBy("kind", "hash").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= limit).select("kind", "hash").toArrow())
    kind, value = rows.column("kind").to_numpy(), rows.column("hash").to_numpy()
    return [np.sort(value[kind == k].astype(np.int64).view(U64)) for k in range(2)]


def _find(length: int, gram: int, parts: int, sent):
    """Packed anchor occurrences by anchor partition; ``hot`` (sent): anchors dealt by
    context, and contexts dealt by place."""
    def find(batches):
        hot = sent.value
        for cols in _occurrences(length, gram, batches):
            anchor, context, text, pos = cols[:4]
            key = np.where(np.isin(anchor, hot[0]), context, anchor)
            place = mix(text.view(U64) + pos.astype(U64) * U64(0x9E3779B97F4A7C15))
            key = np.where(np.isin(context, hot[1]), place, key)
            out = [(p, *[c.tobytes() for c in part])
                   for p, part in split_parts(part_of(key, parts), parts, *cols)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int32())] +
                    [pa.array([r[i + 1] for r in out], pa.binary()) for i in range(6)],
                    names=["part"] + [f for f, _ in FIELDS])
    return find


def _unpack(table: pa.Table) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(v.as_buffer(), t) for v in table.column(f)])
            for f, t in FIELDS]


def _decide(length: int, sent):
    """Anchor occurrences of one partition: runs of string starts that are repeats
    already (kind 0: from, to), and those to be compared (kind 1, of a hot anchor 2:
    anchor, context, pos, far, near), one for each different context."""
    def decide(table: pa.Table) -> pa.Table:
        hot = sent.value
        anchor, context, text, pos, far, near = _unpack(table)
        order = np.lexsort((pos, text, context, anchor))
        anchor, context, text, pos, far, near = (x[order] for x in (anchor, context, text, pos, far, near))
        n = len(anchor)
        new_a = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        new_c = new_a | np.concatenate(([True], context[1:] != context[:-1]))
        ga, gc = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
        in_c = np.bincount(gc)[gc]                       # occurrences of the context
        contexts = np.bincount(ga[new_c])[ga]            # contexts of the anchor
        crowd = np.isin(anchor, hot[0])                  # the others are in other partitions
        in_c = np.where(np.isin(context, hot[1]), 2, in_c)
        once = np.ones(n, bool)                          # equal texts give equal rows
        once[1:] = new_c[1:] | (text[1:] != text[:-1]) | (pos[1:] != pos[:-1])
        full = (in_c > 1) & once
        ask = ((contexts > 1) | crowd) & new_c
        pos, far, near = pos.astype(np.int64), far.astype(np.int64), near.astype(np.int64)
        k, m = int(full.sum()), int(ask.sum())
        null = pa.nulls(k, pa.int64())
        return pa.table({
            "kind": np.concatenate((np.zeros(k, np.int32), 1 + crowd[ask].astype(np.int32))),
            "text": np.concatenate((text[full], text[ask])),
            "a": np.concatenate((pos[full] - far[full], pos[ask])),
            "b": np.concatenate((pos[full] - near[full], (far[ask] << 16) | near[ask])),
            "anchor": pa.concat_arrays([null, pa.array(anchor[ask].astype(np.int64))]),
            "context": pa.concat_arrays([null, pa.array(context[ask].astype(np.int64))]),
            "many": np.concatenate((np.zeros(k, bool), in_c[ask] > 1))})
    return decide


def _cut_contexts(length: int, parts: int):
    """Bytes of the asked contexts, packed by anchor partition: the part left of
    the anchor (fixed width, right-aligned) and the part from it on."""
    def cut(batches):
        for b in batches:
            seen, rows = set(), []
            texts, asks = b.column(0), b.column(1)
            for i in range(b.num_rows):
                data = texts[i].as_buffer()
                view = memoryview(data)
                for q in asks[i].as_py():
                    name = (q["anchor"], q["context"])
                    if name in seen:
                        continue
                    seen.add(name)
                    p, far, near = q["a"], q["b"] >> 16, q["b"] & 0xFFFF
                    rows.append((q["anchor"], q["text"], p, far, near, q["many"],
                                 bytes(view[p - far:p]), bytes(view[p:p - near + length])))
            if not rows:
                continue
            anchor = np.array([r[0] for r in rows], np.int64)
            part = part_of(anchor.view(U64), parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(anchor)] +
                [pa.array([r[i] for r in rows], t) for i, t in
                 ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int32()), (5, pa.bool_()),
                  (6, pa.binary()), (7, pa.binary()))],
                names=["part", "anchor", "text", "pos", "far", "near", "many", "left", "right"])
    return cut


def _strings(length: int):
    """(hash, text, start) of all strings of the asked contexts."""
    def strings(batches):
        hashes, held, size = ByteHash(1 << 10, seed=29), [], 0

        def sent():
            cols = [np.concatenate([h[i] for h in held]) for i in range(3)]
            return pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["h", "text", "start"])

        for b in batches:
            for v, asks in zip(b.column(0), b.column(1)):
                data = np.frombuffer(v.as_buffer(), np.uint8)
                for q in asks.as_py():
                    p, far, near = q["a"], q["b"] >> 16, q["b"] & 0xFFFF
                    at = np.arange(far - near + 1)
                    h = hashes.spans(hashes.sums(data[p - far:p - near + length]), at, at + length)
                    held.append((h.view(np.int64), np.full(len(at), q["text"], np.int64), p - far + at))
                    size += len(at)
                if size >= HASHES:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()
    return strings


def _matrix(column, width: int, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a zero-padded matrix, and their lengths."""
    rows = [v.as_buffer().to_pybytes() for v in column]
    size = np.array([len(r) for r in rows], np.int64)
    pad = (lambda r: r.rjust(width, b"\0")) if right else (lambda r: r.ljust(width, b"\0"))
    return np.frombuffer(b"".join(map(pad, rows)), np.uint8).reshape(len(rows), width), size


def sort_contexts(group: np.ndarray, right: np.ndarray, size: np.ndarray):
    """Order of the contexts by group, then by their bytes, from the suffix array of
    all blocks, and the common prefix of each with the one before (-1: other group)."""
    m, width = right.shape
    blocks = -(-width // BLOCK)
    padded = np.zeros((m, blocks * BLOCK), np.uint8)
    padded[:, :width] = right
    _, symbol = np.unique(padded.reshape(-1, BLOCK).copy().view(f"S{BLOCK}").ravel(), return_inverse=True)
    text = np.ones((m, blocks + 2), np.int64)            # group, blocks, separator 1
    text[:, 0] = group + 2
    text[:, 1:-1] = symbol.reshape(m, blocks) + 2 + int(group.max()) + 1
    order = suffix_order(np.append(text.ravel(), 0))
    order = order[order % (blocks + 2) == 0]
    order = order[order < m * (blocks + 2)] // (blocks + 2)
    a, b = right[order[1:]], right[order[:-1]]
    differ = a != b
    lcp = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.minimum(lcp, np.minimum(size[order[1:]], size[order[:-1]]))
    lcp[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate(([-1], lcp))


def _compare(length: int, gram: int):
    """String starts of the contexts of one partition that are repeats."""
    width = length - gram

    def compare(table: pa.Table) -> pa.Table:
        name = np.stack([table.column(c).to_numpy() for c in ("anchor", "text", "pos")], 1)
        _, keep = np.unique(name, axis=0, return_index=True)
        table = table.take(pa.array(keep))
        left, _ = _matrix(table.column("left"), width, True)
        right, size = _matrix(table.column("right"), length, False)
        anchor, text, pos, far, near, many = (table.column(c).to_numpy() for c in
                                              ("anchor", "text", "pos", "far", "near", "many"))
        group = np.unique(anchor, return_inverse=True)[1]
        order, lcp = sort_contexts(group, right, size)
        rng = np.random.default_rng(7)
        value = rng.integers(0, 2 ** 63, 256, dtype=U64) * U64(2) + U64(1)
        weight = rng.integers(0, 2 ** 63, width + 1, dtype=U64) * U64(2) + U64(1)
        hit = np.zeros((len(order), width + 1), bool)
        sofar = np.zeros(len(order), U64)                # hash of the x bytes left of the anchor
        sorted_left, lo, hi = left[order], near[order], far[order]
        for x in range(width + 1):
            if x:
                sofar = mix(sofar + value[sorted_left[:, width - x]] * weight[x])
            at = np.flatnonzero((lo <= x) & (x <= hi))
            if len(at) < 2:
                continue
            same = np.cumsum(lcp < length - x)           # agree from the anchor on
            key = mix(sofar[at] ^ (same[at].astype(U64) * U64(0x9E3779B97F4A7C15)))
            by = np.argsort(key, kind="stable")
            eq = key[by][1:] == key[by][:-1]
            dup = np.zeros(len(at), bool)
            dup[by[1:][eq]] = True
            dup[by[:-1][eq]] = True
            hit[at[dup], x] = True
        hit[many[order]] = False                         # known already
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, x0 = np.nonzero(edge == 1)
        _, x1 = np.nonzero(edge == -1)
        where = order[row]
        return pa.table({"text": text[where], "a": pos[where] - (x1 - 1), "b": pos[where] - x0})
    return compare


def _cut_texts(length: int):
    """Digest of each text without its runs."""
    def cut(batches):
        for b in batches:
            out = [[] for _ in range(4)]
            for v, w in zip(b.column(1), b.column(2)):
                data = v.as_buffer().to_pybytes() if v.is_valid else b""
                spans, kept, at, removed = 0, hashlib.sha256(), 0, 0
                for a, e in _runs(w.as_py(), length):
                    kept.update(data[at:a])
                    removed += e - a
                    spans += 1
                    at = e
                kept.update(data[at:])
                for c, x in zip(out, (len(data), removed, spans, kept.hexdigest())):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return cut


def _runs(starts: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal covered byte runs of packed start runs (from << 32 | to)."""
    out: list[list[int]] = []
    for v in sorted(starts or ()):
        a, e = v >> 32, (v & 0xFFFFFFFF) + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


def repeated_starts(texts: DataFrame, length: int = 200) -> DataFrame:
    """(text, starts): for each text (``text`` its hash, ``t`` the string) the runs
    of starts of repeated strings, packed as from << 32 | to."""
    spark = texts.sparkSession
    rows, size = text_stats(texts, "t")
    gram = min(GRAM, max(8, length // 3))
    parts = packed_parts(size, 30 / ((length - gram + 2) / 2))
    hot = hot_hashes(texts, length, gram, size)
    sent = spark.sparkContext.broadcast(hot)      # 2 * HOT_MOST hashes at most
    found = texts.select("text", "t").mapInArrow(
        _find(length, gram, parts, sent), "part int, " + ", ".join(f"{f} binary" for f, _ in FIELDS))
    decided = staged(found.groupBy("part").applyInArrow(
        _decide(length, sent), "kind int, text long, a long, b long, anchor long, context long, many boolean"),
        "suffix-decided")
    known = decided.where("kind = 0").select("text", "a", "b")
    asked = decided.where("kind = 1")
    n_asked = asked.count()
    once = texts.select("text", "t").dropDuplicates(["text"])

    def with_text(asked: DataFrame) -> DataFrame:
        asks = asked.groupBy("text").agg(F.collect_list(F.struct("anchor", "context", "text", "a", "b", "many"))
                                         .alias("asks"))     # at most the anchors of one text
        return once.join(asks, "text").select("t", "asks")

    parts = packed_parts(n_asked, 1.5 * length + 40)
    contexts = (with_text(asked)
                .mapInArrow(_cut_contexts(length, parts), "part int, anchor long, text long, pos long, "
                            "far int, near int, many boolean, left binary, right binary"))
    more = contexts.groupBy("part").applyInArrow(_compare(length, gram), "text long, a long, b long")
    if len(hot[0]):
        crowded = decided.where("kind = 2").dropDuplicates(["anchor", "context"])
        strings = staged(with_text(crowded).mapInArrow(_strings(length), "h long, text long, start long"),
                         "suffix-strings")
        twice = strings.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        more = more.unionByName(strings.join(twice, "h", "left_semi")
                                .select("text", F.col("start").alias("a"), F.col("start").alias("b")))
    return (known.unionByName(more)
            .select("text", F.expr("shiftleft(a, 32) | b").alias("r"))
            .groupBy("text").agg(F.collect_set("r").alias("starts")))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_bytes, n_removed, n_spans, kept_sha256).

    Every byte that a ``length``-byte string covers which also starts elsewhere (in
    any row, the same one included) is removed; overlaps count; matches do not cross
    rows. Null texts are empty; texts shorter than ``length`` keep all. Null ids and
    repeated rows are kept, and a repeated row is "elsewhere". Whole texts of any
    length. Other columns are not read. An empty table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("text"))
    starts = repeated_starts(texts, length)
    kind = docs.schema[id_col].dataType.simpleString()
    return (texts.join(starts, "text", "left").select("id", "t", "starts")
            .mapInArrow(_cut_texts(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, "
                                            "kept_sha256 string")
            .withColumnRenamed("id", id_col))
