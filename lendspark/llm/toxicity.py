"""Toxicity: a small convolutional text classifier, trained in numpy.

A word is the sum of three hashed embeddings (the word, its first four and its
first six characters). Filters of widths 1, 2 and 3 run over the words, each
filter's maximum over the whole text is a feature, and a logistic layer gives the
score. Training: Adam on a bounded, class-balanced sample of labelled documents;
the gradient of a maximum flows to one position, so a step touches few words. A
part of the sample is kept out of training: on it the score is calibrated to the
labels' true share (Platt scaling), and a decision threshold is chosen for each
language. Labels, language, source and id are no inputs of the score.

Scoring never holds more than one slice of a text: maxima over slices (with the
filters' overlap) are the maximum over the text.
"""

from __future__ import annotations

import io
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendspark.session import ensure_checkpoint_dir

ROWS = 1 << 15            # hashed embedding rows
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8               # of each width
SLICE = 20_000            # words convolved at once
CACHE_WORDS = 100_000     # words whose filter products a task keeps
FEATURES = FILTERS * len(WIDTHS)
TRIM = string.punctuation
#: Columns of the word-by-filter products: (first column, filter block, shift).
BLOCKS = [(FILTERS * (sum(WIDTHS[:i]) + j), i, j) for i, w in enumerate(WIDTHS) for j in range(w)]
PRODUCTS = FILTERS * sum(WIDTHS)


def word_rows(word: str) -> tuple[int, int, int]:
    """Embedding rows of a lower-case word."""
    w = word.strip(TRIM)
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % ROWS
                 for x in (w, "4^" + w[:4], "6^" + w[:6]))


def pooled(products: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximum of every filter over rows [begin, end) of each text; rows beyond a
    text's end (two at least) must be zero."""
    n = len(products) - max(WIDTHS) + 1
    out = np.empty((n, FEATURES), np.float32)
    for col, block, shift in BLOCKS:
        dst = out[:, block * FILTERS:(block + 1) * FILTERS]
        src = products[shift:shift + n, col:col + FILTERS]
        if shift:
            dst += src
        else:
            dst[:] = src
    cut = np.empty(2 * len(begin), np.int64)
    cut[0::2], cut[1::2] = begin, end
    return out, np.maximum.reduceat(out, cut[:-1] if cut[-1] == n else cut, axis=0)[::2]


class Model:
    """Weights, calibration and thresholds."""

    FIELDS = ("emb", "conv", "bias", "dense", "scale", "shift")

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.02, (ROWS, DIM)).astype(np.float32)
        self.conv = rng.normal(0, 0.25, (DIM, PRODUCTS)).astype(np.float32)
        self.bias = np.zeros(FEATURES, np.float32)
        self.dense = np.concatenate((rng.normal(0, 0.2, FEATURES), [0.0])).astype(np.float32)
        self.scale, self.shift = np.ones(1), np.zeros(1)
        self.thresholds: dict[str | None, float] = {None: 0.3}

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS},
                 langs=np.array([k for k in self.thresholds if k is not None], dtype="U64"),
                 cuts=np.array([v for k, v in self.thresholds.items() if k is not None]),
                 cut=np.array([self.thresholds[None]]))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        got, m = np.load(io.BytesIO(data)), cls()
        for k in cls.FIELDS:
            setattr(m, k, got[k])
        m.thresholds = {None: float(got["cut"][0])} | {
            str(k): float(v) for k, v in zip(got["langs"], got["cuts"])}
        return m

    def logits(self, pools: np.ndarray) -> np.ndarray:
        return np.maximum(pools + self.bias, 0) @ self.dense[:-1] + self.dense[-1]

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logit.astype(np.float64) + self.shift[0], -60, 60)))


class Scorer:
    """Scores texts; products of words seen before are kept."""

    def __init__(self, model: Model) -> None:
        self.model, self.pending = model, []
        self.index = _Index(self.pending)
        self.table = np.zeros((1024, PRODUCTS), np.float32)     # row 0: padding

    def _flush(self) -> None:
        if not self.pending:
            return
        rows = np.array([word_rows(w) for w in self.pending])
        need = len(self.index) + 1
        if need > len(self.table):
            grown = np.zeros((max(need, min(2 * need, CACHE_WORDS + 2 * SLICE)), PRODUCTS), np.float32)
            grown[:len(self.table)] = self.table
            self.table = grown
        self.table[need - len(rows):need] = self.model.emb[rows].sum(1) @ self.model.conv
        self.pending.clear()

    def __call__(self, texts: Iterable[str], n: int | None = None) -> np.ndarray:
        """Probabilities of lower-cased or mixed texts; "" counts as no word. ``n``:
        how many there are, if ``texts`` has no length."""
        best = np.full((len(texts) if n is None else n, FEATURES), -np.inf, np.float32)
        held: list[tuple[int, list[str], int | None]] = []
        size = 0
        for i, text in enumerate(texts):
            words = text.lower().split()
            step = SLICE - max(WIDTHS) + 1
            for s in range(0, max(1, len(words)), step):
                # windows at the end of a slice that is not the last belong to the next
                held.append((i, words[s:s + SLICE], step if s + SLICE < len(words) else None))
                size += len(held[-1][1]) + 2
                if size >= SLICE:
                    self._pool(held, best)
                    held, size = [], 0
        if held:
            self._pool(held, best)
        return self.model.probability(self.model.logits(best))

    def _pool(self, held, best: np.ndarray) -> None:
        if len(self.index) > CACHE_WORDS:
            self.index.clear()
        ids, begin, end = [], [], []
        for _, words, windows in held:
            begin.append(len(ids))
            ids.extend(map(self.index.__getitem__, words))
            if not words:
                ids.append(0)
            end.append(len(ids) if windows is None else begin[-1] + windows)
            ids += (0, 0)
        self._flush()
        _, top = pooled(self.table[ids], np.array(begin), np.array(end))
        np.maximum.at(best, [i for i, _, _ in held], top)


class _Index(dict):
    """Row of each known word; new words wait in the scorer's list (not the scorer: in
    a cycle with it, the table would outlive its task)."""

    def __init__(self, pending: list[str]) -> None:
        super().__init__()
        self.pending = pending

    def __missing__(self, word):
        self.pending.append(word)
        row = self[word] = len(self) + 1
        return row


def fit(texts: list[str], labels: np.ndarray, langs: list[str | None], share: float,
        epochs: int = 12, batch: int = 64, rate: float = 0.005, seed: int = 5) -> Model:
    """Train, calibrate to the true ``share`` of label 1, choose thresholds."""
    m = Model(seed)
    if len(set(labels.tolist())) < 2:            # nothing to learn: the share itself
        m.dense[:] = 0
        p = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
        m.shift[:] = np.log(p / (1 - p))
        return m
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in t.lower().split()], np.int64)
            for t in texts]
    rows = np.array([word_rows(w) for w in vocab]).reshape(-1, 3)
    order = rng.permutation(len(docs))
    n_cal = max(1, len(docs) // 4)
    cal, train = order[:n_cal], order[n_cal:]
    adam = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))]
            for k in ("emb", "conv", "bias", "dense")}
    step = 0
    for _ in range(epochs):
        train = rng.permutation(train)
        for s in range(0, len(train), batch):
            step += 1
            pick = train[s:s + batch]
            ids, begin, end = _lay(docs, pick)
            word = np.where(ids[:, None] >= 0, rows[ids] if len(rows) else 0, 0)
            x = m.emb[word].sum(1)
            x[ids < 0] = 0
            out, top = pooled(x @ m.conv, begin, end)
            feat = np.maximum(top + m.bias, 0)
            z = feat @ m.dense[:-1] + m.dense[-1]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            g_dense = np.concatenate((feat.T @ err, [err.sum()])).astype(np.float32)
            g_feat = np.outer(err, m.dense[:-1]) * (feat > 0)
            at = np.stack([b + out[b:e].argmax(0) for b, e in zip(begin, end)])
            g_conv, touched, g_x = np.zeros_like(m.conv), [], []
            for col, block, shift in BLOCKS:
                f = slice(block * FILTERS, (block + 1) * FILTERS)
                pos, g = (at[:, f] + shift), g_feat[:, f]
                for k in range(FILTERS):
                    g_conv[:, col + k] += x[pos[:, k]].T @ g[:, k]
                    touched.append(pos[:, k])
                    g_x.append(np.outer(g[:, k], m.conv[:, col + k]))
            touched, g_x = np.concatenate(touched), np.concatenate(g_x)
            real = ids[touched] >= 0
            hit = rows[ids[touched[real]]].ravel() if len(rows) else np.zeros(0, np.int64)
            used, inv = np.unique(hit, return_inverse=True)
            g_emb = np.zeros((len(used), DIM), np.float32)
            np.add.at(g_emb, inv, np.repeat(g_x[real], 3, axis=0))
            g_emb += 1e-5 * m.emb[used]
            for k, g, sub in (("emb", g_emb, used), ("conv", g_conv + 1e-5 * m.conv, slice(None)),
                              ("bias", g_feat.sum(0), slice(None)), ("dense", g_dense, slice(None))):
                a, b = adam[k]
                a[sub] = 0.9 * a[sub] + 0.1 * g
                b[sub] = 0.99 * b[sub] + 0.01 * g * g
                getattr(m, k)[sub] -= (rate * (a[sub] / (1 - 0.9 ** step))
                                       / (np.sqrt(b[sub] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    scorer = Scorer(m)
    m.scale, m.shift = np.ones(1), np.zeros(1)
    p = np.clip(scorer([texts[i] for i in cal]), 1e-9, 1 - 1e-9)
    z, y = np.log(p / (1 - p)), labels[cal].astype(float)
    _calibrate(m, z, y, share, [langs[i] for i in cal])
    return m


def _lay(docs, pick) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of the picked texts, each followed by two paddings (-1)."""
    parts, begin, end, at = [], [], [], 0
    for i in pick:
        d = docs[i] if len(docs[i]) else np.array([-1])
        parts += [d, np.array([-1, -1])]
        begin.append(at)
        end.append(at + len(d))
        at += len(d) + 2
    return np.concatenate(parts), np.array(begin), np.array(end)


def _calibrate(m: Model, z, y, share: float, langs) -> None:
    """Platt scaling and thresholds of best F1, rows weighted to the true share."""
    if 0 < y.sum() < len(y):
        w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        target = np.where(y == 1, 0.98, 0.002)         # soft labels keep the scale finite
        a = np.array([1.0, 0.0])
        for _ in range(50):
            x = np.stack([z, np.ones_like(z)], 1)
            p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
            g = x.T @ (w * (p - target)) + 1e-3 * (a - [1.0, 0.0])
            h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            move = np.linalg.solve(h, g)
            a -= move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        m.scale, m.shift = a[:1], a[1:]
        p = m.probability(z)
        for lang in [None, *sorted({v for v in langs if v is not None})]:
            sel = np.array([lang is None or v == lang for v in langs])
            if y[sel].sum() >= 10:                    # few cases: the general threshold
                m.thresholds[lang] = _best_cut(p[sel], y[sel], w[sel])


def _best_cut(p, y, w) -> float:
    cuts = np.linspace(0.05, 0.95, 91)
    f1 = [2 * (w * y * (p >= c)).sum() / ((w * y).sum() + (w * (p >= c)).sum() + 1e-12) for c in cuts]
    best = np.flatnonzero(np.isclose(f1, max(f1), atol=1e-9))
    return float(cuts[best[len(best) // 2]])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", lang_col: str | None = "lang", per_class: int = 2000,
          max_words: int = 6_000_000, **options) -> Model:
    """Fit on a bounded sample: of each class the ``per_class`` labelled ids with the
    smallest hashes, whole texts, up to ``max_words`` words in all. Rows with a null
    id or label are not used; an id with several labels counts as its largest."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    lab = (labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
           .where("i IS NOT NULL AND y IS NOT NULL").groupBy("i").agg(F.max("y").alias("y")))
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    picks = [lab.where(F.col("y") == v).orderBy(F.xxhash64("i"), "i").limit(per_class) for v in (0, 1)]
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    sample = (docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"),
                          lang.alias("lang"))
              .join(F.broadcast(picks[0].union(picks[1])), "i")       # 2 * per_class ids
              .select(F.coalesce("t", F.lit("")).alias("t"), "y", "lang", F.xxhash64("i", "t").alias("o"))
              .repartition(1).sortWithinPartitions("o"))

    def fit_one(batches):
        texts, ys, langs, words = [], [], [], 0
        for b in batches:
            for t, y, g in zip(*(b.column(i).to_pylist() for i in range(3))):
                if words < max_words:
                    texts.append(t)
                    ys.append(y)
                    langs.append(g)
                    words += t.count(" ") + 1
        model = fit(texts, np.array(ys, dtype=np.float64), langs, share, **options)
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], names=["m"])

    made = sample.mapInArrow(fit_one, "m binary").first()       # none: an empty plan has no task
    return Model.from_bytes(bytes(made["m"])) if made else fit([], np.zeros(0), [], share)


def score_column(model: Model, text: Column) -> Column:
    """Score of a text column (null counts as empty), 0 to 1."""
    sent = model.to_bytes()        # about 2 MB

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # of this task alone
        scorer = Scorer(Model.from_bytes(sent))
        for texts in batches:
            yield pa.array(scorer((t.as_py() or "" for t in texts), len(texts)), pa.float64())

    return score(F.coalesce(text.cast("string"), F.lit("")))


def threshold_column(model: Model, lang: Column | None) -> Column:
    """The language's threshold; other languages and null: the general one."""
    out = F.lit(model.thresholds[None])
    for name, cut in model.thresholds.items():
        if name is not None and lang is not None:
            out = F.when(lang.cast("string") == name, F.lit(cut)).otherwise(out)
    return out


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str | None = "lang") -> DataFrame:
    """One row per input row: (id, score, toxic boolean by the language's threshold).

    Null and empty texts have no words and get the score of that; null ids and
    languages and repeated rows are kept. Other columns are not read. An empty
    table gives an empty result; without labels of both classes every score is the
    labels' share of 1."""
    lang = F.col(lang_col) if lang_col else None
    return (docs.select(F.col(id_col), score_column(model, F.col(text_col)).alias("score"),
                        threshold_column(model, lang).alias("cut"))
            .select(id_col, "score", (F.col("score") >= F.col("cut")).alias("toxic")))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents below their language's threshold, all columns unchanged."""
    name = "score__toxicity"
    return (docs.withColumn(name, score_column(model, F.col("text")))
            .where(F.col(name) < threshold_column(model, F.col("lang"))).drop(name))
