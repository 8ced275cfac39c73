"""Spelling variants: words of the corpus one edit apart, grouped under frequent forms.

The near pairs are the language of A o E o A, where A is the minimised acceptor of the
vocabulary and E a transducer that inserts, deletes or replaces one code point. A pair
one edit apart agrees in its first or in its last code points, half of the shortest
word's length, so the composition starts from the states that A and the acceptor of the
reversed words reach by such a prefix: each of these initial states is a partition. A
partition with more than ``GROUP`` words is replaced by those of its successor states;
the pairs that take their edit right there have the rest of the word in common and are
joined on it. So no task holds more than ``GROUP`` words and nothing is left out. Words of
more than ``LONG_WORD`` code points start from states that read all but a few blocks.

Words are counted in numpy, with the CRC-32 of all runs of a group of texts at once;
words leave a task once for each ``FLUSH`` different ones it met.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.llm.common import ByteHash, row_slices, staged, text_groups
from lendspark.session import ensure_checkpoint_dir

GROUP = 20_000            # words whose acceptor one task builds
FLUSH = 400_000           # different words that a task holds
LONG = 64                 # bytes: longer runs are hashed one by one
LONG_WORD = 256           # code points: longer words are first shortened by whole blocks
BLOCK = 128

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True      # 0xC3 begins U+00C0 to U+00FF
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def letter_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8."""
    word = LETTER[data]
    word[1:] |= data[:-1] == 0xC3
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] continued from the CRC-32 values ``seed``."""
    order = np.argsort(start - end, kind="stable")              # longest first
    start, size = start[order], (end - start)[order]
    reg = seed[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    longs = int(np.searchsorted(-size, -LONG))
    for i in range(longs):
        piece = data[start[i]:start[i] + size[i]].tobytes()
        reg[i] = np.uint32(zlib.crc32(piece, int(reg[i]) ^ 0xFFFFFFFF)) ^ np.uint32(0xFFFFFFFF)
    if longs < len(size):
        rest, first = reg[longs:], start[longs:]
        still = np.searchsorted(-size[longs:], -np.arange(1, int(size[longs]) + 1), side="right")
        for j, k in enumerate(still.tolist()):                  # byte j of the k runs that have one
            rest[:k] = CRC[(rest[:k] ^ data[first[:k] + j]) & 255] ^ (rest[:k] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    return out


def _pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] as an Arrow string column."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))


def _count_words(least: int, modulus: int):
    """(word, n) of the runs of all texts of a task."""
    def run(batches):
        hasher = ByteHash()
        keys, counts, names, held = [], [], [], 0

        def flush():
            key, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            n = np.bincount(back, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(names).take(pa.array(first)), pa.array(n)], names=["word", "n"])

        for b in (part for whole in batches for part in row_slices(whole, 1)):
            ids = b.column(0).to_pylist()
            for first, bounds, data in text_groups(b.column(1)):
                data = LOWER[data]
                start, end = letter_runs(data)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                size = points[end] - points[start]
                keep = size >= least
                start, end, size = start[keep], end[keep], size[keep]
                if not len(start):
                    continue
                row = np.searchsorted(bounds, start, side="right") - 1
                seed = np.array([zlib.crc32(f"{'' if i is None else i}:".encode())
                                 for i in ids[first:first + len(bounds) - 1]], np.uint32)[row]
                h = crc32_of(data, start, end, seed)
                cut = h % np.uint32(modulus) == 0
                changed = []
                for s, e, c, k in zip(start[cut], end[cut], size[cut].tolist(), h[cut].tolist()):
                    if c > least:
                        w = data[s:e].tobytes().decode()
                        changed.append(w[:k % c] + w[k % c + 1:])
                start, end = start[~cut], end[~cut]
                key, at, n = np.unique(hasher.spans(hasher.sums(data), start, end), return_index=True,
                                       return_counts=True)
                keys.append(key)
                counts.append(n)
                names.append(_pieces(data, start[at], end[at]))
                if changed:
                    raw = [w.encode() for w in changed]
                    flat = np.frombuffer(b"".join(raw), np.uint8)
                    stop = np.cumsum([len(w) for w in raw])
                    keys.append(hasher.spans(hasher.sums(flat), np.concatenate(([0], stop[:-1])), stop))
                    counts.append(np.ones(len(raw), np.int64))
                    names.append(pa.array(changed, pa.string()))
                held += len(key) + len(changed)
                if held >= 4 * FLUSH:                       # repeats among groups are dropped first
                    out = flush()
                    keys = [_keys_of(hasher, out.column(0))]
                    counts, names, held = [out.column(1).to_numpy()], [out.column(0)], out.num_rows
                    if held >= FLUSH:
                        yield out
                        keys, counts, names, held = [], [], [], 0
        if held:
            yield flush()
    return run


def _keys_of(hasher: ByteHash, words: pa.Array) -> np.ndarray:
    raw = [w.as_buffer() for w in words]
    stop = np.cumsum([len(w) for w in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    return hasher.spans(hasher.sums(flat), np.concatenate(([0], stop[:-1])), stop)


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, modulus: int = 199,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``least_length`` code points met ``least_count`` times."""
    return (docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t"))
            .where("t IS NOT NULL").mapInArrow(_count_words(least_length, modulus), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct strings: ``edges[state]`` maps a code
    point to the next state, ``final[state]`` tells whether the state accepts."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def settled(edges: dict[str, int], final: bool) -> int:
            key = (final, *edges.items())
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.edges)
                self.edges.append(edges)
                self.final.append(final)
            return state

        path: list[tuple[dict[str, int], str]] = []     # unsettled nodes above the last one
        node, end, last = {}, False, ""
        for w in words:
            same = 0
            while same < len(last) and same < len(w) and last[same] == w[same]:
                same += 1
            while len(path) > same:
                state = settled(node, end)
                (node, end), by = path[-1][0], path[-1][1]
                node[by] = state
                path.pop()
            for c in w[same:]:
                path.append(((node, end), c))
                node, end = {}, False
            end, last = True, w
        while path:
            state = settled(node, end)
            (node, end), by = path.pop()
            node[by] = state
        self.start = settled(node, end)


def one_edit_pairs(words: list[str]):
    """Pairs of sorted distinct strings that differ by exactly one inserted, deleted or
    replaced code point, each once: accepted paths of the composition, whose edit is
    taken where the two words first differ."""
    a = Acceptor(words)
    edges, final = a.edges, a.final
    shared: dict[tuple[int, int], list[str]] = {}
    local: dict[int, list[tuple[str, str]]] = {}

    def common(x: int, y: int) -> list[str]:
        """Strings that both states accept (after the edit both copies of the vocabulary
        acceptor must go on alike)."""
        if x > y:
            x, y = y, x
        found = shared.get((x, y))
        if found is None:
            ex, ey = edges[x], edges[y]
            found = [""] if final[x] and final[y] else []
            for c in ex.keys() & ey.keys():
                found += [c + v for v in common(ex[c], ey[c])]
            shared[x, y] = found
        return found

    def edits_at(state: int) -> list[tuple[str, str]]:
        """Rests of the two words where the edit is the next move from ``state``."""
        out = []
        out_of = list(edges[state].items())
        for i, (c, x) in enumerate(out_of):
            for d, y in out_of[:i]:                                     # replaced
                out += [(c + v, d + v) for v in common(x, y)]
            if final[state] and final[x]:                               # one code point more
                out.append(("", c))
            deeper = edges[x]
            for d, y in out_of:
                if d != c and d in deeper:
                    out += [(d + v, c + d + v) for v in common(y, deeper[d])]
        return out

    todo = [(a.start, "")]
    while todo:
        state, prefix = todo.pop()
        found = local.get(state)
        if found is None:
            found = local[state] = edits_at(state)
        for v, w in found:
            yield prefix + v, prefix + w
        for c, x in edges[state].items():
            todo.append((x, prefix + c))


def _state_pairs(table: pa.Table) -> pa.Table:
    """Unordered near pairs of the words of one state: what they read from ``state`` on."""
    read, rest = table.column("read")[0].as_py(), table.column("rest").to_pylist()
    count = dict(zip(rest, table.column("n").to_pylist()))
    a, b = [], []
    for x, y in one_edit_pairs(sorted(rest)):
        a.append(x)
        b.append(y)
    return pa.table({"state": pa.array([table.column("state")[0].as_py()] * len(a), pa.string()),
                     "a": pa.array([read + x for x in a], pa.string()), "b": pa.array([read + y for y in b], pa.string()),
                     "n_a": pa.array([count[x] for x in a], pa.int64()), "n_b": pa.array([count[y] for y in b], pa.int64())})


def _long_states(batches):
    """Initial states of words too long to be read one code point at a time: all but
    about three blocks is read, some blocks from the front and the others from the back, in every
    way of which two near words share one."""
    for t in batches:
        out = []
        for word, n in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
            blocks = len(word) // BLOCK
            heads, tails = [hashlib.blake2b(digest_size=16)], [hashlib.blake2b(digest_size=16)]
            for k in range(blocks):
                heads.append(heads[-1].copy())
                heads[-1].update(word[k * BLOCK:(k + 1) * BLOCK].encode())
                tails.append(tails[-1].copy())
                tails[-1].update(word[len(word) - (k + 1) * BLOCK:len(word) - k * BLOCK].encode())
            for k in range(blocks + 1):
                most = max(0, (len(word) - (k + 1) * BLOCK) // BLOCK)
                for m in {most, max(0, most - 1)}:
                    out.append((f"l{k}:{m}:{heads[k].hexdigest()}{tails[m].hexdigest()}",
                                word[k * BLOCK:len(word) - m * BLOCK], word, n))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i == 3 else pa.string())
                                          for i in range(4)], names=["state", "rest", "word", "n"])


def _pairs_by_state(rows: DataFrame) -> DataFrame:
    """(state, a, b, n_a, n_b): near pairs among the rests of each state. ``rows``: (state,
    rest, n). States with too many words go on to their successors."""
    found, schema = [], "state string, a string, b string, n_a long, n_b long"
    rows = rows.withColumn("read", F.lit(""))
    while True:
        rows = staged(rows, "spell-states")
        hot = staged(rows.groupBy("state", "read").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > GROUP).drop("c"),
                     "spell-hot")
        any_hot = hot.limit(1).count()
        small = rows.join(hot, ["state", "read"], "left_anti") if any_hot else rows
        found.append(small.groupBy("state", "read").applyInArrow(_state_pairs, schema))
        if not any_hot:
            break
        large = rows.join(hot, ["state", "read"], "left_semi")
        # where the edit comes next, what is left behind it is the same in both words
        x = large.where("rest != ''").select("state", "read", F.expr("substring(rest, 2)").alias("tail"),
                                             F.col("rest").alias("a"), F.col("n").alias("n_a"))
        same = x.select("state", "read", "tail", F.col("a").alias("b"), F.col("n_a").alias("n_b"))
        short = large.select("state", "read", F.col("rest").alias("tail"), F.col("rest").alias("b"), F.col("n").alias("n_b"))
        on = ["state", "read", "tail"]
        pairs = (x.join(same, on).where("a > b").unionByName(x.join(short, on))
                 .where("substring(a, 1, 1) != substring(b, 1, 1)"))
        found.append(pairs.select("state", F.concat("read", "a").alias("a"), F.concat("read", "b").alias("b"), "n_a", "n_b"))
        rows = large.where("rest != ''").select(
            "state", F.concat("read", F.substring("rest", 1, 1)).alias("read"), F.expr("substring(rest, 2)").alias("rest"), "n")
    return reduce(DataFrame.unionByName, found)


def near_pairs(words: DataFrame, depth: int) -> DataFrame:
    """(word, near, n of near): ordered pairs one edit apart. ``words``: (word, n), each
    once, of at least 2 * ``depth`` code points."""
    both = [F.struct(F.lit("f").alias("way"), F.col("word").alias("w")),
            F.struct(F.lit("r").alias("way"), F.reverse("word").alias("w"))]
    size = F.length("word")
    rows = (words.where(size <= LONG_WORD + 1).select("n", F.explode(F.array(*both)).alias("x"))
            .select(F.concat("x.way", F.substring("x.w", 1, depth)).alias("state"),
                    F.expr(f"substring(x.w, {depth + 1})").alias("rest"), "n"))
    found = _pairs_by_state(rows)
    head, back = F.expr("substring(state, 2)"), F.col("state").startswith("r")
    whole = lambda c: F.when(back, F.reverse(F.concat(head, F.col(c)))).otherwise(F.concat(head, F.col(c)))
    found = found.select(back.alias("back"), whole("a").alias("a"), whole("b").alias("b"), "n_a", "n_b").where(
        ~F.col("back") | (F.substring("a", 1, depth) != F.substring("b", 1, depth))).drop("back")
    if words.where(size > LONG_WORD).limit(1).count():
        rows = staged(words.where(size >= LONG_WORD).mapInArrow(
            _long_states, "state string, rest string, word string, n long"), "spell-long")
        pairs = _pairs_by_state(rows.select("state", "rest", "n"))
        for c in "ab":
            pairs = pairs.join(rows.select("state", F.col("rest").alias(c), F.col("word").alias(f"word_{c}")), ["state", c])
        pairs = pairs.where(F.greatest(F.length("word_a"), F.length("word_b")) > LONG_WORD + 1).select(
            F.col("word_a").alias("a"), F.col("word_b").alias("b"), "n_a", "n_b").distinct()
        found = found.unionByName(pairs)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))
    return found.select(F.explode(ends).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last, by doubling."""
    now = staged(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = staged(now.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spell-roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, modulus: int = 199,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: (word, n, n_near, form, form_n, root).

    Words come from maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of
    at least ``least_length`` code points, met ``least_count`` times in all. Where the
    CRC-32 of '<id>:<run>' is a multiple of ``modulus`` the run loses one code point. Near
    words differ by one inserted, deleted or replaced code point; a word's form is its
    most frequent near word (ties: the smallest in code-point order) if that is at least
    ``ratio`` times as frequent; the root is the last of the forms that follow each other.
    Null and empty texts have no words, a null id is written as nothing before the colon;
    repeated rows count each. Whole texts of any length; other columns are not read. An
    empty table gives an empty result. ``least_length`` must be 2 or more, ``ratio`` over 1.
    """
    if least_length < 2 or ratio <= 1:
        raise ValueError("least_length must be 2 or more and ratio over 1")
    ensure_checkpoint_dir(docs.sparkSession)
    words = staged(vocabulary(docs, least_length, least_count, modulus, id_col, text_col), "spell-words")
    near = (near_pairs(words, least_length // 2).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "near")).alias("best")))
    table = staged(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.m") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"),
                                                               (-F.col("best.m")).alias("n"))).alias("f")), "spell-near")
    last = roots(table.where("f IS NOT NULL").select("word", F.col("f.form").alias("form")))
    return (table.join(last, "word", "left")
            .select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n"),
                    F.coalesce("root", "word").alias("root")))
