"""A gated recurrent language model with a class-factored output.

A word's class follows from its letters: the cluster (of documents, by k-means
over hashed byte trigrams) under which its trigrams are likeliest, how it ends, and
whether it is one of the sample's most frequent words. A recurrent network with
gates (GRU) reads the words so far and gives a softmax over classes; inside a class
the softmax has one free logit a word, fitted in closed form: the smoothed log count
over all training documents. The network is trained in numpy by truncated
backpropagation through time, in two steps. It starts on one task (``sample_docs`` documents,
``max_tokens`` tokens). Then all training documents are dealt, by hash of the id, to shards
of about equal size, as many as the corpus asks for; every shard goes on from the same
weights over all words of its documents, and the shards' weights are averaged, weighted
by their tokens. So the network learns from the whole corpus, and no task's share grows.

The network's arrays hold one column a text, so that sums over classes and slices of the
gates run along whole rows. Scoring steps all texts of an Arrow batch at once, longest
first, and carries the state to the very end of each, so the result is the whole document's log
likelihood. Word counts come from all training documents by one shuffle; the most
frequent words' counts (``HEAD`` of them) travel with the task, all others are
looked up where they were counted: (word, document, times) goes there, packed, and
sums come back.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendspark.llm.common import (U64, WordHash, packed_parts, part_of, row_slices, split_parts, staged,
                                  text_groups, text_stats)
from lendspark.session import ensure_checkpoint_dir

CLUSTERS, ENDINGS, TRIGRAMS = 6, 4, 4096
KINDS = CLUSTERS * ENDINGS
CLASSES = 2 * KINDS + 1            # the last is the end of a text
END = CLASSES - 1
FREQUENT = 1000                    # words with an input row of their own
HIDDEN = 16
SHARD_BYTES = 16 << 20             # training text of one shard
STREAM_TOKENS = 4_096              # of a shard's stream, from 64 streams to 512
MERGE = 64                         # weights averaged by one task
HEAD = 65_536                      # word counts sent to every task
SLOT_BITS = 18                     # words whose classes a task remembers, by hash
LN10 = np.log(10.0)


class WordTable:
    """Hashes, classes and input rows of all words of a group of texts. A word's class
    follows from its letters, so it is found once and kept in the slot of the word's hash,
    until another word takes the slot."""

    def __init__(self, trigram: np.ndarray, frequent: np.ndarray) -> None:
        self.hash, self.trigram, self.frequent = WordHash(), trigram, frequent
        lower = np.arange(256, dtype=np.int64)
        lower[65:91] += 32
        lower[[9, 10, 11, 12, 13]] = 32
        self.lower = lower
        ending = np.full(256, 3, np.int64)
        ending[128:] = 0
        ending[[c for c in range(128) if chr(c).isalnum()]] = 0
        ending[ord(".")], ending[ord(",")] = 1, 2
        self.ending = ending
        self.seen = np.zeros(1 << SLOT_BITS, U64)
        self.seen[0] = ~U64(0)                 # of another slot: no slot holds its own word yet
        self.seen_cls, self.seen_inp = np.zeros((2, 1 << SLOT_BITS), np.int16)

    def trigrams(self, data: np.ndarray) -> np.ndarray:
        b = np.concatenate(([32], self.lower[data]))
        return (b[:-2] * 961 + b[1:-1] * 31 + b[2:]) & (TRIGRAMS - 1)

    def __call__(self, bounds: np.ndarray, data: np.ndarray):
        """(hash, text index, class, input row) of each word."""
        h, row, start, end = self.hash(bounds, data)
        if not len(h):
            return h, row, row, row
        slot = (h >> U64(64 - SLOT_BITS)).astype(np.int64)
        cls, inp = self.seen_cls[slot], self.seen_inp[slot]
        new = np.flatnonzero(self.seen[slot] != h)
        if len(new):
            cls[new], inp[new] = self.classes(h[new], start[new], end[new], data)
            slot = slot[new]
            self.seen[slot], self.seen_cls[slot], self.seen_inp[slot] = h[new], cls[new], inp[new]
        return h, row, cls, inp

    def classes(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray):
        """(class, input row) of the words at [start, end) of ``data``."""
        size = end - start
        first = np.cumsum(size) - size
        at = np.repeat(start - first, size) + np.arange(size.sum())
        before, own, after = self.lower[data[at - 1]], self.lower[data[at]], self.lower[data[at + 1]]
        tri = (before * 961 + own * 31 + after) & (TRIGRAMS - 1)
        # trigrams from the space before to the one after
        score = np.stack([np.add.reduceat(column[tri], first) for column in self.trigram.T])
        cls = score.argmax(0) * ENDINGS + self.ending[data[end - 1]]
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
            known = self.frequent[at] == h
        else:
            at, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        cls = cls + KINDS * known
        return cls, np.where(known, CLASSES + at, cls)


class Model:
    """Word classes and network weights."""

    FIELDS = ("trigram", "frequent", "wx", "wh", "out", "bias")

    def __init__(self, trigram, frequent, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.trigram, self.frequent = trigram, frequent
        rows = CLASSES + FREQUENT
        self.wx = rng.normal(0, 0.1, (rows, 3 * HIDDEN)).astype(np.float32)
        self.wh = rng.normal(0, 0.5 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32)
        self.bias = np.zeros(CLASSES, np.float32)

    def to_bytes(self) -> bytes:
        buf = io.BytesIO()
        np.savez(buf, **{k: getattr(self, k) for k in self.FIELDS})
        return buf.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        got = np.load(io.BytesIO(data))
        m = cls(got["trigram"], got["frequent"])
        for k in cls.FIELDS[2:]:
            setattr(m, k, got[k])
        return m

    def gates(self, h: np.ndarray, x: np.ndarray):
        """New state, a column a text, from a state and the words' input, a row a text, and
        what backpropagation needs."""
        u = h.T @ self.wh
        g = np.empty((2 * HIDDEN, len(u)), np.float32)
        np.add(u[:, :2 * HIDDEN].T, x[:, :2 * HIDDEN].T, out=g)
        g *= np.float32(0.5)
        np.tanh(g, out=g)
        g *= np.float32(0.5)
        g += np.float32(0.5)
        z, r, un = g[:HIDDEN], g[HIDDEN:], np.ascontiguousarray(u[:, 2 * HIDDEN:].T)
        n = r * un
        n += x[:, 2 * HIDDEN:].T
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, (z, r, n, un)

    def logits(self, h: np.ndarray):
        """Class scores less their maximum, a column a text, and the log of their
        exponentials' sum (eight sums side by side, as numpy sums a row)."""
        y = np.empty((CLASSES, h.shape[1]), np.float32)
        np.add((h.T @ self.out).T, self.bias[:, None], out=y)
        y -= y.max(0)
        e = np.exp(y)
        s = e[:2 * KINDS].reshape(-1, 8, e.shape[1]).sum(0)
        return y, np.log(((s[0] + s[1]) + (s[2] + s[3])) + ((s[4] + s[5]) + (s[6] + s[7])) + e[END])

    def step(self, h: np.ndarray, inp: np.ndarray):
        """``gates`` with a row a text."""
        new, kept = self.gates(h.T, self.wx.take(inp, 0))
        return new.T, kept

    def log_softmax(self, h: np.ndarray) -> np.ndarray:
        y, log_sum = self.logits(h.T)
        return (y - log_sum).T


def kmeans_trigrams(counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Log-likelihood table (trigram, cluster), scaled to integers."""
    x = np.sqrt(counts)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rng = np.random.default_rng(seed)
    centre = [x[0]] if len(x) else [np.ones(TRIGRAMS) / 64]
    while len(centre) < CLUSTERS:                        # far from those chosen
        gap = 1 - np.max(x @ np.array(centre).T, axis=1) if len(x) else np.zeros(0)
        total = gap.clip(0).sum()
        centre.append(x[rng.choice(len(x), p=gap.clip(0) / total)] if total > 0 else centre[0])
    c = np.array(centre)
    for _ in range(15):
        own = (x @ c.T).argmax(1)
        for k in range(CLUSTERS):
            if (own == k).any():
                c[k] = x[own == k].mean(0)
                c[k] /= max(np.linalg.norm(c[k]), 1e-9)
    own = (x @ c.T).argmax(1) if len(x) else np.zeros(0, np.int64)
    total = np.stack([counts[own == k].sum(0) for k in range(CLUSTERS)], 1) + 0.2
    return np.round(1024 * np.log(total / total.sum(0))).astype(np.int64)


def fit(texts: list[str], max_tokens: int = 400_000, epochs: int = 2, streams: int = 64,
        window: int = 32, rate: float = 0.01, seed: int = 3) -> Model:
    """Classes and network from sample texts."""
    column = pa.array(texts, pa.string())
    base = WordTable(np.zeros((TRIGRAMS, CLUSTERS), np.int64), np.zeros(0, U64))
    docs, hashes = [], []
    for _, bounds, data in text_groups(column):
        tri = np.concatenate((base.trigrams(data), [0]))
        for a, b in zip(bounds, bounds[1:]):
            docs.append(np.bincount(tri[a:b - 1], minlength=TRIGRAMS).astype(np.float64))
        hashes.append(base(bounds, data)[0])
    trigram = kmeans_trigrams(np.array(docs).reshape(-1, TRIGRAMS), seed)
    word, n = np.unique(np.concatenate([*hashes, np.zeros(0, U64)]), return_counts=True)
    frequent = np.sort(word[np.lexsort((word, -n))][:FREQUENT])
    m = Model(trigram, frequent, seed)
    seqs = sequences(m, texts)
    if seqs:
        _train(m, seqs, max_tokens, epochs, streams, window, rate, seed)
    return m


def sequences(m: Model, texts: list[str]):
    """(classes to predict, input rows) of each text, its end included."""
    table, seqs, end = WordTable(m.trigram, m.frequent), [], np.array([END], np.int16)
    for _, bounds, data in text_groups(pa.array(texts, pa.string())):
        _, row, cls, inp = table(bounds, data)
        cut = np.searchsorted(row, np.arange(len(bounds)))
        cls, inp = cls.astype(np.int16), inp.astype(np.int16)
        for a, b in zip(cut, cut[1:]):
            seqs.append((np.concatenate((cls[a:b], end)), np.concatenate((end, inp[a:b]))))
    return seqs


def _train(m: Model, seqs, max_tokens: int | None, epochs: int, streams: int, window: int,
           rate: float, seed: int, start: bool = True) -> None:
    """Truncated backpropagation: ``streams`` texts' words side by side, the state
    carried from window to window and cleared where a text begins."""
    rng = np.random.default_rng(seed)
    names = ("wx", "wh", "out", "bias")
    adam = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in names}
    if start:
        freq = np.bincount(np.concatenate([s[0] for s in seqs]), minlength=CLASSES) + 0.5
        m.bias[:] = np.log(freq / freq.sum())
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        tgt = np.concatenate([seqs[i][0] for i in order])[:max_tokens]
        inp = np.concatenate([seqs[i][1] for i in order])[:max_tokens]
        length = max(1, len(tgt) // streams)
        width = min(streams, len(tgt) // length)
        tgt, inp = (np.ascontiguousarray(v[:width * length].reshape(width, length).T) for v in (tgt, inp))
        column = np.arange(width)
        state = np.zeros((HIDDEN, width), np.float32)
        for t0 in range(0, length, window):
            step += 1
            h, tape = state, []
            rows = inp[t0:t0 + window]
            scale = np.float32(1.0 / rows.size)
            grad = {k: np.zeros_like(getattr(m, k)) for k in names}
            for t, row in enumerate(rows):
                keep = row != END
                h_in = h * keep
                h, kept = m.gates(h_in, m.wx.take(row, 0))
                dy, log_sum = m.logits(h)
                dy -= log_sum
                np.exp(dy, out=dy)
                dy[tgt[t0 + t], column] -= 1
                dy *= scale
                tape.append((h_in, kept, h, np.ascontiguousarray(dy.T), keep))
            state = h
            dh = np.zeros_like(h)
            dx = np.empty((3 * HIDDEN, len(rows), width), np.float32)      # last step first
            for back, (h_in, (z, r, n, un), h_t, dy, keep) in enumerate(reversed(tape)):
                grad["out"] += h_t @ dy
                grad["bias"] += dy.sum(0)
                dh += (dy @ m.out.T).T
                dn = dh * (1 - z) * (1 - n * n)
                du = np.empty((3 * HIDDEN, width), np.float32)
                np.multiply(dh * (h_in - n) * z, 1 - z, out=du[:HIDDEN])
                np.multiply(dn * un * r, 1 - r, out=du[HIDDEN:2 * HIDDEN])
                dx[:2 * HIDDEN, back], dx[2 * HIDDEN:, back] = du[:2 * HIDDEN], dn
                np.multiply(dn, r, out=du[2 * HIDDEN:])
                grad["wh"] += h_in @ du.T
                dh *= z
                dh += (du.T @ m.wh.T).T
                dh *= keep
            at = rows[::-1].ravel()
            by_row = np.argsort(at, kind="stable")
            used, first = np.unique(at[by_row], return_index=True)
            grad["wx"][used] = np.add.reduceat(dx.reshape(3 * HIDDEN, -1).take(by_row, 1, mode="clip"), first, axis=1).T
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * min(1.0, 1.0 / (norm + 1e-9)) / (1 + step / 400)
            for k in names:
                a, b = adam[k]
                a += 0.1 * (grad[k] - a)
                b += 0.01 * (grad[k] * grad[k] - b)
                getattr(m, k)[...] -= lr * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)


def train(docs: DataFrame, in_training: Column, id_col: str, text_col: str, sample_docs: int,
          max_tokens: int) -> Model:
    """Fit on the ``sample_docs`` training documents with the smallest id hashes."""
    pick = (docs.where(in_training).select(F.col(id_col).alias("i")).where("i IS NOT NULL").distinct()
            .orderBy(F.xxhash64("i"), "i").limit(sample_docs))
    sample = (docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
              .join(F.broadcast(pick), "i", "left_semi").where("t IS NOT NULL")
              .select("t", F.xxhash64("i", "t").alias("o")).repartition(1).sortWithinPartitions("o"))

    def fit_one(batches):
        texts, words = [], 0
        for b in batches:
            for v in b.column(0):
                if words < max_tokens:
                    texts.append(v.as_py())
                    words += texts[-1].count(" ") + 2
        yield pa.RecordBatch.from_arrays(
            [pa.array([fit(texts, max_tokens).to_bytes()], pa.binary())], names=["m"])

    made = sample.mapInArrow(fit_one, "m binary").first()       # none: an empty plan has no task
    return Model.from_bytes(bytes(made["m"])) if made else fit([])


def _learn_shard(model: bytes, rate: float):
    """Weights after one pass over a shard's documents, times its tokens: (shard, tokens,
    weights)."""
    def learn(table: pa.Table) -> pa.Table:
        m = Model.from_bytes(model)
        order = np.argsort(table.column("o").to_numpy(), kind="stable")
        seqs = sequences(m, table.column("t").take(pa.array(order)).to_pylist())
        shard = table.column("shard")[0].as_py()
        tokens = sum(len(c) for c, _ in seqs)
        _train(m, seqs, None, 1, min(512, max(64, tokens // STREAM_TOKENS)), 32, rate, 3 + shard, start=False)
        w = np.concatenate([getattr(m, k).ravel() for k in Model.FIELDS[2:]]).astype(np.float64) * tokens
        return pa.table({"shard": pa.array([shard], pa.int64()),
                         "tokens": pa.array([tokens], pa.int64()), "w": pa.array([w.tobytes()], pa.binary())})
    return learn


def _add_weights(table: pa.Table) -> pa.Table:
    w = sum(np.frombuffer(v.as_buffer(), np.float64) for v in table.column("w"))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py() // MERGE], pa.int64()),
                     "tokens": pa.array([sum(table.column("tokens").to_pylist())], pa.int64()),
                     "w": pa.array([w.tobytes()], pa.binary())})


def refine(model: Model, docs: DataFrame, in_training: Column, id_col: str, text_col: str,
           one_in: int = 1, shard_bytes: int | None = None, rate: float = 0.002) -> Model:
    """The model after a pass of all shards, their weights averaged. The number of shards
    follows the bytes of the training texts. ``one_in`` over 1 learns from one in so many
    documents, by hash of the id. Null ids take no part."""
    shard_bytes = shard_bytes or SHARD_BYTES
    base = docs.where(in_training).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(
        "i IS NOT NULL AND t IS NOT NULL")
    size = int(base.agg(F.sum(F.octet_length("t"))).first()[0] or 0)
    shards = max(1, -(-size // shard_bytes))
    schema = "shard long, tokens long, w binary"
    learned = (base.where(F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(one_in)) == 0)
               .select("t", F.xxhash64("i", "t").alias("o"), F.pmod(F.xxhash64("i", F.lit("shard")), F.lit(shards)).alias("shard"))
               .groupBy("shard").applyInArrow(_learn_shard(model.to_bytes(), rate), schema))
    n = shards
    while True:
        learned = learned.groupBy(F.floor(F.col("shard") / MERGE).alias("g")).applyInArrow(_add_weights, schema)
        n = -(-n // MERGE)
        if n <= 1:
            break
    row = learned.first()                        # one row: the sum of all shards
    if row is None or not row["tokens"]:
        return model
    out, at = Model.from_bytes(model.to_bytes()), 0
    w = np.frombuffer(bytes(row["w"]), np.float64) / row["tokens"]
    for k in Model.FIELDS[2:]:
        v = getattr(out, k)
        setattr(out, k, w[at:at + v.size].reshape(v.shape).astype(np.float32))
        at += v.size
    return out


def _count(model: bytes, parts: int):
    """Packed (word, class, count) of the training texts by word partition."""
    def count(batches):
        m = Model.from_bytes(model)
        table = WordTable(m.trigram, m.frequent)
        for b in (part for whole in batches for part in row_slices(whole)):
            got = [table(bounds, data)[::2] for _, bounds, data in text_groups(b.column(0))]
            if not got:
                continue
            h, cls = (np.concatenate([g[i] for g in got]) for i in (0, 1))
            word, at, n = np.unique(h, return_index=True, return_counts=True)
            out = [(p, *[c.tobytes() for c in cols]) for p, cols in
                   split_parts(part_of(word, parts), parts, word, n.astype(np.int64), cls[at].astype(np.uint8))]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int32())] +
                    [pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3)],
                    names=["part", "word", "n", "cls"])
    return count


def _blob(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in column if v.is_valid]
                          + [np.zeros(0, kind)])


def _total(table: pa.Table) -> pa.Table:
    """Sorted words of a partition with their counts, its class totals, and its
    candidates for the most frequent words."""
    part = table.column("part")[0].as_py()
    word, n, cls = (_blob(table.column(c), k) for c, k in (("word", U64), ("n", np.int64), ("cls", np.uint8)))
    words, at, inv = np.unique(word, return_index=True, return_inverse=True)
    n = np.bincount(inv, weights=n, minlength=len(words)).astype(np.int64)
    cls = cls[at]
    in_class = np.bincount(cls, weights=n, minlength=CLASSES).astype(np.int64)
    types = np.bincount(cls, minlength=CLASSES).astype(np.int64)
    top = np.lexsort((words, -n))[:HEAD]
    return pa.table({"part": pa.array([part], pa.int32()), "word": pa.array([words.tobytes()], pa.binary()),
                     "n": pa.array([n.tobytes()], pa.binary()),
                     "in_class": pa.array([in_class.tolist()], pa.list_(pa.int64())),
                     "types": pa.array([types.tolist()], pa.list_(pa.int64())),
                     "top_word": pa.array([words[top].view(np.int64).tolist()], pa.list_(pa.int64())),
                     "top_n": pa.array([n[top].tolist()], pa.list_(pa.int64()))})


def log10_counts(n, totals: dict) -> np.ndarray:
    return np.log10((n + 0.5) / (totals["N"] + 0.5 * (totals["V"] + 1)))


def log10_in_class(n, cls, totals: dict) -> np.ndarray:
    return np.log10((n + 0.5) / (totals["class_n"][cls] + 0.5 * (totals["class_types"][cls] + 1)))


def sequence_scores(m: Model, inp: np.ndarray, cls: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Natural log probability of the class sequence of every text; text i holds
    words [cut[i], cut[i + 1]), then the end."""
    length = np.diff(cut).astype(np.int32) + 1
    if not len(length):
        return np.zeros(0)
    order = np.argsort(-length, kind="stable")
    begin, length = cut[:-1][order].astype(np.int32), length[order]
    # tokens are dealt to steps: a step holds the next token of each text that has one
    texts, n = len(length), int(length.sum())
    text = np.repeat(np.arange(texts, dtype=np.int32), length)
    t = np.arange(n, dtype=np.int32) - np.repeat(np.cumsum(length, dtype=np.int32) - length, length)
    active = np.searchsorted(-length, -np.arange(length[0]), side="left").astype(np.int32)
    step = np.concatenate(([0], np.cumsum(active))).astype(np.int32)
    at = step[t] + text
    end = t == length[text] - 1
    word = (begin[text] + t)[~end]
    tgt, row_in = np.full((2, n), END, np.int16)
    tgt[at[~end]], row_in[(at + active[t])[~end]] = cls[word], inp[word]
    odds = np.empty(n, np.float32)
    h = np.zeros((HIDDEN, texts), np.float32)
    column = np.arange(texts)
    for a, b in zip(step, step[1:]):
        h, _ = m.gates(h[:, :b - a], m.wx.take(row_in[a:b], 0))
        y, log_sum = m.logits(h)
        odds[a:b] = y[tgt[a:b], column[:b - a]] - log_sum
    total = np.empty(texts)
    total[order] = np.bincount(text, odds[at], texts)
    return total


def _score(sent, parts: int, id_type):
    """Per batch of texts: one packed row of the texts' own results, and the words
    outside the head, packed by word partition."""
    def score(batches):
        blob, head_word, head_n, totals = sent.value
        m = Model.from_bytes(blob)
        table = WordTable(m.trigram, m.frequent)
        for k, b in enumerate(part for whole in batches for part in row_slices(whole, 1, 16 << 20)):
            batch = (TaskContext.get().partitionId() << 32) | k
            got = []
            for first, bounds, data in text_groups(b.column(1)):
                h, row, cls, inp = table(bounds, data)
                got.append((h, (row + first).astype(np.int32), cls.astype(np.uint8), inp.astype(np.int16)))
            h, row, cls, inp = (np.concatenate([g[i] for g in got]) for i in range(4))
            rows = b.num_rows
            cut = np.searchsorted(row, np.arange(rows + 1))
            seq = sequence_scores(m, inp, cls, cut) / LN10
            at = np.minimum(np.searchsorted(head_word, h), max(len(head_word) - 1, 0))
            head = head_word[at] == h if len(head_word) else np.zeros(len(h), bool)
            n = head_n[at[head]]
            r, c = row[head], cls[head]
            ends = totals["ends"]
            base = np.bincount(r, log10_counts(n, totals), rows) + log10_counts(ends, totals)
            inner = np.bincount(r, log10_in_class(n, c, totals), rows) + seq
            known = np.bincount(r, minlength=rows) + int(ends > 0)
            tail = ~head
            out = []
            if tail.any():
                out = [(p, *[x.tobytes() for x in cols]) for p, cols in split_parts(
                    part_of(h[tail], parts), parts, h[tail], row[tail].astype(np.int32), cls[tail].astype(np.uint8))]
            names = ["kind", "part", "batch", "word", "row", "cls", "ids", "tokens", "known", "base", "score"]
            k_out = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * k_out + [0], pa.int32()),
                 pa.array([r[0] for r in out] + [parts + batch % parts], pa.int32()),
                 pa.array([batch] * (k_out + 1), pa.int64()),
                 *[pa.array([r[i] for r in out] + [None], pa.binary()) for i in (1, 2, 3)],
                 pa.array([None] * k_out + [b.column(0).to_pylist()], pa.list_(id_type)),
                 *[pa.array([None] * k_out + [v.tobytes()], pa.binary()) for v in
                   ((np.diff(cut) + 1).astype(np.int64), known.astype(np.int64), base, inner)]],
                names=names)
    return score


def _lookup(totals: dict):
    """Sums of one word partition's words for the texts they came from."""
    def lookup(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.equal(table.column("kind"), 0))
        words = table.filter(pa.compute.equal(table.column("kind"), 2))
        asked = table.filter(pa.compute.equal(table.column("kind"), 1))
        word, n = _blob(words.column("word"), U64), _blob(words.column("row"), np.int64)
        out = []
        for i in range(asked.num_rows):
            h, row, cls = (np.frombuffer(asked.column(c)[i].as_buffer(), k) for c, k in
                           (("word", U64), ("row", np.int32), ("cls", np.uint8)))
            at = np.minimum(np.searchsorted(word, h), max(len(word) - 1, 0))
            c = np.where(word[at] == h, n[at], 0) if len(word) else np.zeros(len(h), np.int64)
            rows, inv = np.unique(row, return_inverse=True)
            out.append((asked.column("batch")[i].as_py(), rows.astype(np.int32).tobytes(),
                        np.bincount(inv, c > 0).astype(np.int64).tobytes(),
                        np.bincount(inv, log10_counts(c, totals)).tobytes(),
                        np.bincount(inv, log10_in_class(c, cls, totals)).tobytes()))
        ids = own.column("ids")
        k = len(out)
        return pa.table({
            "batch": pa.concat_arrays([pa.array([o[0] for o in out], pa.int64()),
                                       *own.column("batch").chunks]),
            "row": pa.array([o[1] for o in out] + [None] * own.num_rows, pa.binary()),
            "ids": pa.concat_arrays([pa.nulls(k, ids.type), *ids.chunks]),
            "tokens": pa.concat_arrays([pa.nulls(k, pa.binary()), *own.column("tokens").chunks]),
            "known": pa.concat_arrays([pa.array([o[2] for o in out], pa.binary()), *own.column("known").chunks]),
            "base": pa.concat_arrays([pa.array([o[3] for o in out], pa.binary()), *own.column("base").chunks]),
            "score": pa.concat_arrays([pa.array([o[4] for o in out], pa.binary()), *own.column("score").chunks])})
    return lookup


def _gather(table: pa.Table) -> pa.Table:
    """The texts of one batch with their sums."""
    own = table.filter(pa.compute.is_null(table.column("row")))
    part = table.filter(pa.compute.is_valid(table.column("row")))
    known, base, score = (np.frombuffer(own.column(c)[0].as_buffer(), k).copy() for c, k in
                          (("known", np.int64), ("base", float), ("score", float)))
    for i in range(part.num_rows):
        row = np.frombuffer(part.column("row")[i].as_buffer(), np.int32)
        for total, c, k in ((known, "known", np.int64), (base, "base", float), (score, "score", float)):
            total[row] += np.frombuffer(part.column(c)[i].as_buffer(), k)
    return pa.table({"id": own.column("ids").combine_chunks().flatten()
                     if own.num_rows else own.column("ids").chunk(0).flatten(),
                     "n_tokens": np.frombuffer(own.column("tokens")[0].as_buffer(), np.int64),
                     "n_known": known, "base_score": base, "score": score})


def score_documents(docs: DataFrame, in_training: Column, id_col: str = "doc_id",
                    text_col: str = "text", sample_docs: int = 1500,
                    max_tokens: int = 400_000) -> DataFrame:
    """One row per input row: (id, n_tokens, n_known, train_tokens, base_score, score).

    Tokens: words without ASCII white space, A-Z lower-cased, then one end. ``score``
    is the model's log10 probability of the whole text, ``base_score`` that of add-half
    smoothed counts over all training rows (``in_training``; null counts as false).
    Null and empty texts are the end alone. Null ids and repeated rows are kept (a null
    id is never in the sample). Texts of any length are scored to their end. Other
    columns are not read. Without training rows all counts are zero and the network is
    untrained; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    learn = F.coalesce(in_training, F.lit(False))
    model = refine(train(docs, learn, id_col, text_col, sample_docs, max_tokens), docs, learn, id_col, text_col)
    blob = model.to_bytes()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    rows, size = text_stats(docs, text_col)
    parts = packed_parts(size, 0.35)
    training = docs.where(learn).select(text)
    ends = training.count()
    counted = staged(training.mapInArrow(_count(blob, parts), "part int, word binary, n binary, cls binary")
                     .groupBy("part").applyInArrow(
                         _total, "part int, word binary, n binary, in_class array<long>, types array<long>, "
                                 "top_word array<long>, top_n array<long>"), "lm-counts")
    sums = {c: np.zeros(CLASSES, np.int64) for c in ("in_class", "types")}
    for c in sums:
        for r in counted.select(F.posexplode(c)).groupBy("pos").agg(F.sum("col").alias("v")).collect():
            sums[c][r["pos"]] = r["v"]
    totals = {"N": int(sums["in_class"].sum()) + ends, "V": int(sums["types"].sum()) + int(ends > 0),
              "ends": ends, "class_n": sums["in_class"], "class_types": sums["types"]}
    head = (counted.select(F.explode(F.arrays_zip("top_word", "top_n")).alias("z")).select("z.*")
            .orderBy(F.desc("top_n"), "top_word").limit(HEAD).toArrow())          # HEAD rows
    word = head.column(0).to_numpy().astype(np.int64).view(U64)
    order = np.argsort(word)
    sent = spark.sparkContext.broadcast((blob, word[order], head.column(1).to_numpy()[order], totals))

    kind = docs.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type
    # kept, since its parts meet again by row number: a task run anew must not number otherwise
    scored = staged(docs.select(F.col(id_col), text).mapInArrow(
        _score(sent, parts, to_arrow_type(docs.schema[id_col].dataType)),
        "kind int, part int, batch long, word binary, row binary, cls binary, "
        f"ids array<{kind}>, tokens binary, known binary, base binary, score binary"), "lm-scored")
    table = counted.select(F.lit(2).alias("kind"), "part", F.lit(None).cast("long").alias("batch"), "word",
                           F.col("n").alias("row"))
    looked = (scored.unionByName(table, allowMissingColumns=True).groupBy("part").applyInArrow(
        _lookup(totals), f"batch long, row binary, ids array<{kind}>, tokens binary, known binary, "
                         "base binary, score binary"))
    return (looked.groupBy("batch").applyInArrow(
        _gather, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
        .select(F.col("id").alias(id_col), "n_tokens", "n_known",
                F.lit(totals["N"]).cast("long").alias("train_tokens"), "base_score", "score"))
