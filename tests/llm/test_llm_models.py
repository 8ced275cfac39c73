"""The two trained models: held-out accuracy, brute-force bases, awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from llm_corpus import docs, frame, no_docs, rows  # noqa: F401

from lendspark.llm import gru_lm, toxicity

BAD = ["scumword", "trashtalk", "vilething"]


def labelled(n=900, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 60))]
        y = rng.random() < 0.3
        if y:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "s", ".", "!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    return rows, labels


def test_toxicity_held_out(spark, rows):
    data, labels = labelled()
    df = frame(spark, data + [(None if i is None else i + 10_000, t) for i, t in rows])
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (10_031, 0)], "doc_id long, toxic int")
    model = toxicity.train(df.where("doc_id < 600"), lab)
    got = toxicity.classify(df, model).collect()
    assert len(got) == len(data) + len(rows) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    y = dict(labels)
    held = range(600, 900)
    right = sum((score[i] >= 0.3) == bool(y[i]) for i in held)
    assert right >= 0.95 * len(held)
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r.toxic for r in got)


def test_toxicity_slices_equal_whole_text():
    m = toxicity.Model()
    text = " ".join(f"w{i * 7 % 501}" for i in range(50_001))
    whole = toxicity.Scorer(m)([text, "", "a b", text[:500]])
    toxicity.SLICE, old = 1000, toxicity.SLICE
    try:
        assert np.allclose(toxicity.Scorer(m)([text, "", "a b", text[:500]]), whole)
    finally:
        toxicity.SLICE = old
    again = toxicity.Model.from_bytes(m.to_bytes())
    assert np.allclose(toxicity.Scorer(again)([text]), whole[:1])


def test_toxicity_slices_add_no_windows(monkeypatch):
    """Distinct words: a window (last words of a slice, padding) would show."""
    m = toxicity.Model()
    texts = [" ".join(f"t{i}w{j}" for j in range(n)) for i, n in enumerate(range(8, 60))]
    whole = toxicity.Scorer(m)(texts)
    monkeypatch.setattr(toxicity, "SLICE", 10)
    assert np.allclose(toxicity.Scorer(m)(texts), whole, rtol=1e-6)


def test_toxicity_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert toxicity.classify(no_docs, model).collect() == []
    assert all(r.score < 0.01 for r in toxicity.classify(docs, model).collect())


def in_training():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1


def test_lm_counts_against_brute_force_and_gain(spark, rows):
    rng = random.Random(3)
    data = list(rows)
    for i in range(300):                     # two languages with words of their own
        a = "xyz" if i % 2 else "abc"
        data.append((500 + i, " ".join("".join(rng.choice(a) for _ in range(3)) for _ in range(50))))
    got = gru_lm.score_documents(frame(spark, data).repartition(3), in_training()).collect()
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in data]
    learn = [w for i, w in tokens if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(x for w in learn for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(
        math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.doc_id and r.doc_id >= 500 and zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_sequence_steps_equal_one_by_one():
    m = gru_lm.fit(["a b c. d, e", "x y z", "", "é ñ " * 40])
    table = gru_lm.WordTable(m.trigram, m.frequent)
    import pyarrow as pa
    texts = ["a b c.", "", "x " * 90, "d, e x y", " "]
    (_, bounds, data), = gru_lm.text_groups(pa.array(texts))
    _, row, cls, inp = table(bounds, data)
    cut = np.searchsorted(row, np.arange(len(bounds)))
    got = gru_lm.sequence_scores(m, inp, cls, cut)
    for i in range(len(texts)):
        h, x, total = np.zeros((1, gru_lm.HIDDEN), np.float32), gru_lm.END, 0.0
        for t in range(cut[i], cut[i + 1] + 1):
            h, _ = m.step(h, np.array([x]))
            y = cls[t] if t < cut[i + 1] else gru_lm.END
            total += m.log_softmax(h)[0, y]
            x = inp[t] if t < cut[i + 1] else x
        assert abs(total - got[i]) < 1e-3 * abs(total)


def test_lm_probabilities_sum_to_one_in_each_class():
    m = gru_lm.fit(["a b c. d, e", "x y z"])
    assert abs(np.exp(m.log_softmax(np.zeros((1, gru_lm.HIDDEN), np.float32))).sum() - 1) < 1e-5
    totals = {"class_n": np.array([7]), "class_types": np.array([3])}
    n = np.array([4, 2, 1, 0])               # three words and one unknown
    assert abs((10 ** gru_lm.log10_in_class(n, np.zeros(4, int), totals)).sum() - 1) < 1e-12


def test_lm_shards_go_on_and_are_averaged(spark):
    """As many shards as the corpus asks for; the averaged weights predict texts that no
    task saw better than those they began with."""
    rng = random.Random(4)
    follow = {a: [rng.choice("uvwxyz") * 2 for _ in range(2)] for a in "abcdefgh"}

    def text():
        out = []
        for _ in range(40):
            a = rng.choice("abcdefgh")
            out += [a * 3, rng.choice(follow[a])]
        return " ".join(out)
    data = [(i, text()) for i in range(400)] + [(None, text()), (1000, None), (1001, "")]
    docs = frame(spark, data).repartition(3)
    start = gru_lm.train(docs, F.lit(True), "doc_id", "text", 30, 2_000)
    size = sum(len(t or "") for i, t in data if i is not None)
    learn = gru_lm._learn_shard
    done = gru_lm.refine(start, docs, F.lit(True), "doc_id", "text", one_in=1, shard_bytes=size // 5)
    again = gru_lm.refine(start, docs, F.lit(True), "doc_id", "text", one_in=1, shard_bytes=size // 5)
    assert np.allclose(done.wx, again.wx)
    held = gru_lm.sequences(start, [text() for _ in range(50)])
    cls, inp = np.concatenate([c[:-1] for c, _ in held]), np.concatenate([x[1:] for _, x in held])
    cut = np.concatenate(([0], np.cumsum([len(c) - 1 for c, _ in held])))
    before, after = (gru_lm.sequence_scores(m, inp, cls, cut).sum() for m in (start, done))
    assert after > before
    # the weights are the mean of the shards', by tokens
    import pyarrow as pa
    parts = [learn(start.to_bytes(), 0.002)(pa.table({"t": [text() for _ in range(k)], "o": list(range(k)),
                                                      "shard": [k] * k})) for k in (3, 5)]
    total = gru_lm._add_weights(pa.concat_tables(parts))
    assert total.column("tokens")[0].as_py() == sum(p.column("tokens")[0].as_py() for p in parts)
    assert gru_lm.refine(start, frame(spark, []), F.lit(True), "doc_id", "text") is start


def test_lm_empty(spark, no_docs):
    assert gru_lm.score_documents(no_docs, in_training()).collect() == []
