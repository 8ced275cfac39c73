"""Jaccard self-join of word-shingle sets by token-combination prefixes.

Tokens are the 64-bit hashes of a text's distinct word shingles. All sets use one
token order: rare tokens first, then the frequent ones by rising frequency. Two
sets that reach the threshold must meet inside their prefixes, and the prefix is
indexed by class: every rare token by itself, frequent tokens (in at least one of
``FREQUENT`` sets) only as combinations of two tokens of one class, for which the
prefix is extended until its tokens, less one for each frequent class, outnumber
the allowed differences. (If every class shared fewer tokens than its
combinations have, more tokens would differ than the threshold allows.) Frequent
tokens are dealt to classes by hash, about a quarter as many classes as tokens, so
combinations stay linear in the set; the classes depend on the power of two in the
set's size, and a set near a power of two is indexed under both.

Equal sets are one vertex. A posting carries the set's size and how many tokens the
set has from this place of the order on: two sets that meet first here share no more
than the smaller of these caps, so members of a signature that no other can link with
by sizes and caps leave it before any pair is made (documents of a template that differ
in words of their own meet nobody). Pairs must also have compatible parity sketches
(the set bits of the difference are a lower bound of the sets' difference); pairs that
pass are verified on the full sets. First each signature's members are compared with
its best connected member only, on 256 bits; then, with the components known, the
pairs between different components on sketches of as many bits as tokens (8,192 at
most), closest first, without any limit in the last round. No link between different
components is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.llm.common import (U64, WordHash, mix, packed_parts, part_of, row_slices, split_parts, staged,
                                  text_groups)
from lendspark.llm.components import components
from lendspark.session import ensure_checkpoint_dir

FREQUENT = 8192           # a token is frequent in 1 of so many sets, and in 8 at least
SKETCH_WORDS = 4          # 256 parity bits travel with every posting of the first round
WIDE_WORDS = 128          # as many bits as tokens, 8,192 at most, with those that are left after it
LOW = U64((1 << 40) - 1)  # bits by which tokens are counted: a mix-up only changes an order
BITMAP_BITS = 1 << 23     # ids asked for, as a hashed bitmap of 1 MB
ROUNDS = (4, None)        # closest pairs tried for two components of a signature
SHINGLE = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                            0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93,
                            0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class ShingleSets:
    """Sorted distinct shingle hashes of every text of an Arrow column."""

    def __init__(self, n: int) -> None:
        self.n, self.words = n, WordHash()

    def __call__(self, texts):
        """Yield (row, sorted set); texts without words are not listed."""
        n = self.n
        for first, bounds, data in text_groups(texts):
            h, row, _, _ = self.words(bounds, data)
            lo = np.searchsorted(row, np.arange(len(bounds)))
            if len(h) >= n:
                s = h[:len(h) - n + 1] * SHINGLE[0]
                for k in range(1, n):
                    s = s + h[k:len(h) - n + 1 + k] * SHINGLE[k % 8]
                s = mix(s)
            for i in np.flatnonzero(lo[1:] > lo[:-1]).tolist():
                a, b = lo[i], lo[i + 1]
                if b - a >= n:
                    yield first + i, np.unique(s[a:b - n + 1])
                else:                       # the whole short sequence as one shingle
                    x = U64(b - a)
                    with np.errstate(over="ignore"):
                        for v in h[a:b]:
                            x = x * SHINGLE[0] + v * SHINGLE[1]
                    yield first + i, mix(np.array([x], U64))


def set_key(s: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed) - (1 << 63)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the set's tokens over a power of two of bits, as many as tokens."""
    n_bits = max(64 * SKETCH_WORDS, 1 << (len(s) - 1).bit_length())
    bits = np.bincount((s & U64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(mark: bytes, size: int) -> np.ndarray:
    """A sketch folded to ``size`` bytes: the sketch over fewer bits."""
    m = np.frombuffer(mark, np.uint8)
    return np.bitwise_xor.reduce(m.reshape(-1, size), axis=0)


def _scan_sets(n: int, seed: int):
    """(id, size, set key, check key, sketch) of every text."""
    def scan(batches):
        sets = ShingleSets(n)
        for b in (part for whole in batches for part in row_slices(whole, 1)):
            rows, sizes, keys, checks, marks = [], [], [], [], []
            for i, s in sets(b.column(1)):
                rows.append(i)
                sizes.append(len(s))
                keys.append(set_key(s, seed))
                checks.append(set_key(s, seed + 1))
                marks.append(sketch(s))
            empty = np.setdiff1d(np.arange(b.num_rows), rows)
            none = [None] * len(empty)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.concatenate([rows, empty]).astype(np.int64))),
                 pa.array(np.concatenate([sizes, np.zeros(len(empty))]).astype(np.int64)),
                 pa.array(keys + none, pa.int64()), pa.array(checks + none, pa.int64()),
                 pa.array(marks + none, pa.binary())],
                names=["id", "n", "key", "check", "sketch"])
    return scan


def _tokens(n: int, seed: int, parts: int):
    """Packed low 40 bits of all tokens, once for each different set of a slice."""
    def tokens(batches):
        sets = ShingleSets(n)
        for b in (part for whole in batches for part in row_slices(whole)):
            seen = {set_key(s, seed): s for _, s in sets(b.column(0))}
            if not seen:
                continue
            t = np.concatenate(list(seen.values())) & LOW
            out = [(p, c.view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
                   for p, (c,) in split_parts(part_of(t, parts), parts, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()),
                                              pa.array([r[1] for r in out], pa.binary())], names=["part", "token"])
    return tokens


def _heavy(least: int):
    """Tokens of one partition in at least ``least`` sets, with their counts."""
    def heavy(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(v.as_py() for v in table.column("token")), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        token, count = np.unique(wide.view(U64).ravel(), return_counts=True)
        keep = count >= least
        return pa.table({"token": token[keep].astype(np.int64), "f": count[keep]})
    return heavy


def prefix_signatures(s: np.ndarray, allowed: int, percent: int, freq: np.ndarray,
                      level_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set and, for each, the most tokens that it can share with a set
    that has no token before this signature in common with it (all rare tokens come
    before a combination). ``allowed``: prefix tokens needed. ``freq``: sorted low bits
    of frequent tokens, ``level_of`` their frequency levels."""
    low = s & LOW
    at = np.searchsorted(freq, low)
    frequent = (freq[np.minimum(at, len(freq) - 1)] == low) if len(freq) else np.zeros(len(s), bool)
    rare = s[~frequent]
    if len(rare) >= allowed:
        return rare[:allowed], len(s) - np.arange(allowed)
    tail = s[frequent]
    tail = tail[np.argsort(level_of[at[frequent]], kind="stable")]
    n, out = len(s), [rare]
    lo, hi = -(-percent * n // 100), 100 * n // percent
    for level in {lo.bit_length(), hi.bit_length(), n.bit_length()}:
        classes = max(1, (1 << level) // 8)
        cls = (mix(tail.copy()) % U64(classes)).astype(np.int64)
        first = np.zeros(len(tail), bool)
        first[np.unique(cls, return_index=True)[1]] = True
        usable = len(rare) + np.cumsum(~first)          # tokens less one for each class
        end = min(int(np.searchsorted(usable, allowed)) + 1, len(tail))
        order = np.lexsort((tail[:end], cls[:end]))
        t, c = tail[:end][order], cls[:end][order]
        for k in range(1, end):                         # pairs k apart within a class
            same = c[k:] == c[:-k]
            if not same.any():
                break
            out.append(mix(t[:-k][same] * SHINGLE[0] + t[k:][same] * SHINGLE[1] + U64(level)))
    out = np.concatenate(out)
    return out, len(s) - np.minimum(np.arange(len(out)), len(rare))


def _post(n: int, seed: int, percent: int, freq: np.ndarray, level_of: np.ndarray, parts: int):
    """Packed postings (part; signature, set key, size, cap), once for each different
    set of a batch. Sets too small to reach the threshold unless equal have none: the
    closest other set has one token more, m of m + 1 in common."""
    def post(batches):
        sets = ShingleSets(n)
        for b in (part for whole in batches for part in row_slices(whole)):
            sig, key, size, cap, seen = [], [], [], [], set()
            for _, s in sets(b.column(0)):
                k = set_key(s, seed)
                m = len(s)
                if k in seen or 100 * m < percent * (m + 1):
                    continue
                seen.add(k)
                x, c = prefix_signatures(s, m - (-(-percent * m // 100)) + 1, percent, freq, level_of)
                sig.append(x)
                cap.append(c.astype(np.int32))
                key.append(np.full(len(x), k, np.int64))
                size.append(np.full(len(x), m, np.int32))
            if not sig:
                continue
            sig, key, size, cap = (np.concatenate(v) for v in (sig, key, size, cap))
            out = [(p, *[c.tobytes() for c in cols])
                   for p, cols in split_parts(part_of(sig, parts), parts, sig, key, size, cap)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32())] +
                [pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3, 4)],
                names=["part", "sig", "key", "n", "cap"])
    return post


def _can_link(group: np.ndarray, n: np.ndarray, cap: np.ndarray, percent: int) -> np.ndarray:
    """Members of each group (rows in group order) that another member may link with by
    sizes and caps. Two sets of n and m tokens share at most the smaller cap, and link if
    that is p / (100 + p) of n + m at least: m <= ``most`` of the one, n <= that of the
    other. So a member needs one whose size is within its own bound and whose bound is
    its size or more."""
    most = cap.astype(np.int64) * (100 + percent) // percent - n
    order = np.lexsort((n, group))
    g, size, bound = group[order], n[order].astype(np.int64), most[order]
    wide = int(max(bound.max(initial=0), 0)) + 2
    code = np.cumsum(np.concatenate(([0], g[1:] != g[:-1]))[:len(g)]).astype(np.int64)
    top = np.maximum.accumulate(code * wide + np.maximum(bound, 0))     # anew in each group, as code rises
    widest = int(size.max(initial=0)) + 1
    place = code * (widest + 1) + size
    upto = np.searchsorted(place, code * (widest + 1) + np.clip(bound, -1, widest), side="right") - 1
    first = np.searchsorted(code, code)
    ok = upto >= first
    ok &= np.where(ok, top[np.maximum(upto, 0)] - code * wide, -1) >= size
    out = np.zeros(len(n), bool)
    out[order] = ok
    return out


def _live(percent: int):
    """Postings of the signatures that several different sets share, without those that
    no other member can link with."""
    def live(table: pa.Table) -> pa.Table:
        get = lambda c, t: np.concatenate([np.frombuffer(v.as_buffer(), t)
                                           for v in table.column(c)])
        sig, key, n, cap = get("sig", U64), get("key", np.int64), get("n", np.int32), get("cap", np.int32)
        order = np.lexsort((key, sig))
        sig, key, n, cap = sig[order], key[order], n[order], cap[order]
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key, n, cap = sig[keep], key[keep], n[keep], cap[keep]
        for able in (False, True):
            if able:
                ok = _can_link(sig, n, cap, percent)
                sig, key, n, cap = sig[ok], key[ok], n[ok], cap[ok]
            same = sig[1:] == sig[:-1]
            ok = np.concatenate((same, [False])) | np.concatenate(([False], same))
            ok = ok[:len(sig)]
            sig, key, n, cap = sig[ok], key[ok], n[ok], cap[ok]
        return pa.table({"sig": sig.astype(np.int64), "key": key, "n": n.astype(np.int64), "cap": cap.astype(np.int64)})
    return live


POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Sketches:
    """Parity sketches of a bin's sets, each as wide as it is; two are compared at the
    width of the narrower."""

    def __init__(self, marks: list[bytes]) -> None:
        self.width = np.array([len(m) for m in marks], np.int64)
        self.row = np.zeros(len(marks), np.int64)
        self.own: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.own[w] = np.frombuffer(b"".join(marks[k] for k in at.tolist()), np.uint8).reshape(len(at), w)

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits by which the sketches of the sets i and j differ."""
        out = np.zeros(len(i), np.int64)
        narrow = np.minimum(self.width[i], self.width[j])
        wide = np.maximum(self.width[i], self.width[j])
        for w, v in set(zip(narrow.tolist(), wide.tolist())):
            at = np.flatnonzero((narrow == w) & (wide == v))
            step = max(1, (8 << 20) // v)
            for q in range(0, len(at), step):
                k = at[q:q + step]
                swap = self.width[i[k]] > w
                x, y = np.where(swap, j[k], i[k]), np.where(swap, i[k], j[k])
                b = self.own[v][self.row[y]]
                if v > w:
                    b = np.bitwise_xor.reduce(b.reshape(len(k), v // w, w), axis=1)
                out[k] = np.bitwise_count(self.own[w][self.row[x]] ^ b).sum(1, dtype=np.int64)
        return out


def _cross_pairs(cut: np.ndarray, row: np.ndarray, n: np.ndarray, cap: np.ndarray, comp: np.ndarray, percent: int):
    """Blocks of pairs of different sets (indices) that meet in a group, are of different
    components, and may link by sizes and caps. Group g has the postings from cut[g] to
    cut[g + 1]; ``row``, ``cap``: their sets and caps; ``n``, ``comp``: by set. In a group
    the largest component comes first, and a member meets those before its own
    component, so members that are connected already are never held against each other."""
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        _, code, size = np.unique(comp[row[s:e]], return_inverse=True, return_counts=True)
        if len(size) < 2:
            continue
        order = np.lexsort((code, -size[code]))
        code = code[order]
        x = row[s:e][order]
        m, c = n[x].astype(np.int32), cap[s:e][order].astype(np.int32)
        before = np.maximum.accumulate(np.where(np.concatenate(([True], code[1:] != code[:-1])), np.arange(e - s), 0))
        # the sets' own bounds: largest partner by the cap, smallest and largest by sizes
        most = np.minimum(c.astype(np.int64) * (100 + percent) // percent - m, 100 * m.astype(np.int64) // percent)
        least = -(-percent * m.astype(np.int64) // 100)
        most, least = most.astype(np.int32), least.astype(np.int32)
        q = int(size.max())                             # rows of the largest component meet nobody before them
        while q < e - s:
            r = min(e - s, q + max(1, 1_000_000 // (q + 1)))
            w = int(before[r - 1])
            ok = (m[None, :w] <= most[q:r, None]) & (m[None, :w] >= least[q:r, None]) & (m[q:r, None] <= most[None, :w])
            ok &= np.arange(w, dtype=np.int32)[None, :] < before[q:r, None].astype(np.int32)
            i, j = np.nonzero(ok)
            if len(i):
                yield x[q + i], x[j]
            q = r


class PairSet:
    """Distinct pairs of at most ``n`` sets, as a table of marks while that is small."""

    def __init__(self, n: int, table: int = 100_000_000) -> None:
        self.n, self.held, self.size = n, [np.zeros(0, np.int64)], 0
        self.marks = np.zeros(n * n, bool) if n * n <= table else None

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        code = np.maximum(x, y).astype(np.int64) * self.n + np.minimum(x, y)
        if self.marks is not None:
            self.marks[code] = True
            return
        self.held.append(code)
        self.size += len(code)
        if self.size > 4_000_000:
            self.held = [np.unique(np.concatenate(self.held))]
            self.size = 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        code = np.flatnonzero(self.marks) if self.marks is not None else np.unique(np.concatenate(self.held))
        return code // max(1, self.n), code % max(1, self.n)


def _candidates(percent: int, most: int | None, star: bool):
    """Pairs worth verifying (a, b, more) of the signatures of a bin: with a signature's
    best connected member (star), or between components, the ``most`` closest of each two;
    ``more``: further pairs of these two components were left for a later round."""
    def pairs(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()                                  # noqa: E731
        order = np.lexsort((get("key"), -get("links"), get("sig")))     # a group's best connected member first
        sig, cap = get("sig")[order], get("cap")[order]
        keys, first, row = np.unique(get("key"), return_index=True, return_inverse=True)
        row = row[order]
        n, comp = get("n")[first], get("comp")[first]
        cut = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True])))
        met = PairSet(len(keys))
        if star:
            lead = np.repeat(cut[:-1], np.diff(cut))
            x, y = row[lead], row
            ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) \
                & ((100 + percent) * np.minimum(cap[lead], cap) >= percent * (n[x] + n[y]))
            met.add(x[ok], y[ok])
        else:
            for x, y in _cross_pairs(cut, row, n, cap, comp, percent):
                met.add(x, y)
        i, j = met.pairs()
        marks = table.column("sketch").take(pa.array(first)).to_pylist()
        d = Sketches(marks).distance(i, j)
        # overlap >= p/(100+p) * total, so difference <= (100-p)/(100+p) * total
        ok = (100 + percent) * d <= (100 - percent) * (n[i] + n[j])
        i, j, d = i[ok], j[ok], d[ok]
        swap = comp[i] < comp[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        left = np.zeros(len(i), bool)
        if most is not None and not star and len(i):
            o = np.lexsort((d, comp[j], comp[i]))
            i, j = i[o], j[o]
            new = np.concatenate(([True], (comp[i][1:] != comp[i][:-1]) | (comp[j][1:] != comp[j][:-1])))
            nth = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
            over = nth >= most
            left[np.flatnonzero(over) - 1] = True
            i, j, left = i[~over], j[~over], left[~over]
        return pa.table({"a": np.minimum(keys[i], keys[j]), "b": np.maximum(keys[i], keys[j]), "more": left})
    return pairs


def _refine(percent: int):
    """Pairs that the full sketches, at the width of the shorter, still allow."""
    def check(batches):
        for b in batches:
            ok = []
            for n_a, n_b, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                size = min(len(x), len(y))
                d = int(POPCOUNT[folded(x, size) ^ folded(y, size)].sum())
                ok.append((100 + percent) * d <= (100 - percent) * (n_a + n_b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(
                pa.array(ok, pa.bool_()))
    return check


def _bitmap(ids: DataFrame) -> bytes:
    """Hashed bitmap of an id column: fixed size, false hits only cost work."""
    pos = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS))
    words = (ids.select((pos / 64).cast("int").alias("w"), (pos % 64).cast("int").alias("k"))
             .groupBy("w").agg(F.expr("bit_or(shiftleft(1L, k))").alias("v"))
             .collect())                                   # at most BITMAP_BITS / 64 rows
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    for r in words:
        bits[r["w"]] = r["v"]
    return bits.tobytes()


def _wanted_sets(n: int, seed: int, bits: bytes):
    def scan(batches):
        flags = np.frombuffer(bits, np.int64)
        sets = ShingleSets(n)
        for b in batches:
            pos = b.column(1).to_numpy()
            b = b.filter(pa.array((flags[pos >> 6] >> (pos & 63)) & 1 == 1))
            found = {set_key(s, seed): s.tobytes() for _, s in sets(b.column(0))}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())],
                names=["key", "tokens"])
    return scan


def _verify(percent: int):
    def check(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                k = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * k >= percent * (len(x) + len(y) - k))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(
                pa.array(ok, pa.bool_()))
    return check


def set_components(docs: DataFrame, words: int, percent: int, id_col: str,
                   text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(rows: id, n, key), (sets: key, component, links) and the key's seed."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    for seed in range(0, 20, 2):        # a set key that names two sets: take the next hash
        scan = staged(base.mapInArrow(_scan_sets(words, seed), f"id {kind}, n long, key long, "
                                      "check long, sketch binary"), "join-sets")
        rows = scan.select("id", "n", "key")
        classes = staged(scan.where("key IS NOT NULL AND id IS NOT NULL").groupBy("key")
                         .agg(F.min("id").alias("id"), F.first("n").alias("n"),
                              F.first("sketch").alias("sketch"), F.min("check").alias("lo"),
                              F.max("check").alias("hi")), "join-classes")
        total = classes.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("t"),
                            F.count_if(F.col("lo") != F.col("hi")).alias("bad")).first()
        if not total["bad"]:
            break
    classes = classes.drop("lo", "hi")

    def fold(width: int):
        @F.pandas_udf("binary")
        def to_width(marks: pd.Series) -> pd.Series:
            return pd.Series([folded(m, width).tobytes() if len(m) > width else m for m in marks], dtype=object)
        return to_width(F.col("full"))

    n_sets, n_tokens = int(total["n"]), int(total["t"] or 0)

    least = max(8, n_sets // FREQUENT)
    n_all = int(rows.agg(F.sum("n")).first()[0] or 0)
    parts = packed_parts(n_all, 5)
    heavy = (base.where("id IS NOT NULL").select("t").mapInArrow(_tokens(words, seed, parts), "part int, token binary")
             .groupBy("part").applyInArrow(_heavy(least), "token long, f long")
             .orderBy("token").toArrow())           # at most FREQUENT * mean size rows
    freq = heavy.column(0).to_numpy().astype(np.int64).view(U64)
    level_of = np.log2(heavy.column(1).to_numpy() + 1.0).astype(np.int8)

    parts = packed_parts(n_tokens, 20 * (1.1 - percent / 100))
    sent = spark.sparkContext.broadcast((freq, level_of))
    posted = (base.where("id IS NOT NULL").select("t")
              .mapInArrow(_lazy(sent, words, seed, percent, parts), "part int, sig binary, key binary, n binary, cap binary"))
    live = staged(posted.groupBy("part").applyInArrow(_live(percent), "sig long, key long, n long, cap long"), "join-live")
    degree = live.groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    members = staged(classes.join(degree, "key").select(
        "key", "id", "n", F.col("sketch").alias("full"), "links"), "join-members")
    n_live = live.count()

    edges, comp = None, members.select("key", F.col("key").alias("comp"))
    settled = False
    for most, star in [(None, True), *[(m, False) for m in ROUNDS]]:
        if settled:
            break
        rounds = live.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        if not star:             # only signatures that several components share
            cross = (rounds.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                     .where("lo != hi").select("sig"))
            rounds = rounds.join(cross, "sig", "left_semi")
        width = 8 * (SKETCH_WORDS if star else WIDE_WORDS)
        rounds = rounds.join(members.select("key", fold(width).alias("sketch"), "links"), "key")
        bins = packed_parts(n_live, 60 + width if star else 400)
        found = (rounds.withColumn("bin", F.pmod(F.xxhash64("sig"), F.lit(bins)).cast("int"))
                 .groupBy("bin").applyInArrow(_candidates(percent, most, star),
                                              "a long, b long, more boolean"))
        found = staged(found.groupBy("a", "b").agg(F.max("more").alias("more")), "join-pairs")
        n_pairs = found.agg(F.count(F.lit(1)).alias("n"), F.max("more").alias("more")).first()
        settled = not star and not n_pairs["more"]      # nothing was left out of this round
        end = lambda k: members.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"),
                                       F.col("full").alias(f"sketch_{k}"))
        found = (found.join(end("a"), "a").join(end("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
                 .mapInArrow(_refine(percent), "a long, b long"))
        found = staged(found, "join-close")
        if n_pairs["n"]:
            ends = found.select(F.explode(F.array("a", "b")).alias("key")).distinct()
            wanted = members.join(ends, "key", "left_semi").select("key", "id")
            bits = _bitmap(wanted)
            pos = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS)).cast("long")
            sets = (base.where("id IS NOT NULL").select("t", pos.alias("pos"))
                    .mapInArrow(_wanted_sets(words, seed, bits), "key long, tokens binary")
                    .join(ends, "key", "left_semi").dropDuplicates(["key"]))
            sets = staged(sets, "join-verify")
            good = (found.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a")
                    .join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
                    .select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"))
            good = staged(good, "join-links")
            if not good.limit(1).count():
                continue                        # components stay; the next round tries more
            edges = good if edges is None else edges.unionByName(good).distinct()
            comp = staged(components(edges).select(F.col("node").alias("key"), F.col("root").alias("comp")),
                          "join-comp")
    named = classes.select("key", "id").join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    lowest = named.groupBy("comp").agg(F.min("id").alias("component"))
    named = named.join(lowest, "comp").select("key", "component")
    if edges is None:
        links = classes.select("key", F.lit(0).cast("long").alias("links")).limit(0)
    else:
        links = (edges.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key")
                 .agg(F.count(F.lit(1)).alias("links")))
    named = staged(named.join(links, "key", "left"), "join-named")
    return rows, named, seed


def shingle_join(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, n_links).

    Words are runs without ASCII white space, A-Z lower-cased. Two documents link
    when 100 * intersection >= ``percent`` * union of their shingle sets; the
    component is the smallest id reachable. ``n_links`` counts the verified links
    that built the component at the document's set (0: alone, or equal sets only).
    A text without words, empty or null has no shingles and is linked with nothing.
    A null id takes no part in links and has a null component. Repeated rows are
    kept; they have equal sets, so one component. Whole texts of any length. Other
    columns are not read. An empty table gives an empty result.
    """
    rows, named, _ = set_components(docs, words, percent, id_col, text_col)
    has = F.col("key").isNotNull() & F.col("id").isNotNull()
    return (rows.join(named, "key", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(has, F.col("component")).otherwise(F.col("id")).alias("component_id"),
                    F.when(has, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
                    .alias("n_links")))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The documents without those linked, directly or through others, to one with
    a smaller id; of repeated rows one stays. Columns are unchanged. Texts without
    words and rows with a null id are linked with nothing and stay."""
    rows, named, seed = set_components(docs, words, percent, id_col, text_col)
    repeated = (rows.where("id IS NOT NULL AND key IS NOT NULL").groupBy("id", "key")
                .agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count())

    @F.pandas_udf("long")
    def key_of(texts: pd.Series) -> pd.Series:
        out = [None] * len(texts)
        for i, s in ShingleSets(words)(pa.array(texts, pa.string())):
            out[i] = set_key(s, seed)
        return pd.Series(out, dtype="Int64")

    key, comp = "set_key__join", "component__join"
    lookup = named.select(F.col("key").alias(key), F.col("component").alias(comp))
    kept = (docs.withColumn(key, key_of(F.col(text_col).cast("string"))).join(lookup, key, "left")
            .where(F.col(comp).isNull() | F.col(id_col).isNull() | (F.col(comp) == F.col(id_col))))
    if repeated:
        one = F.col(id_col).isNotNull() & F.col(key).isNotNull()
        kept = kept.where(one).dropDuplicates([id_col, key]).unionByName(kept.where(~one))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _lazy(sent, words: int, seed: int, percent: int, parts: int):
    def run(batches):
        freq, level_of = sent.value
        yield from _post(words, seed, percent, freq, level_of, parts)(batches)
    return run
