"""op10: words' classes are found once a task; texts are scored side by side."""

import random

import numpy as np
import pyarrow as pa

from lendspark.llm import gru_lm


def _model():
    return gru_lm.fit(["a b c. d, e", "x y z", "", "é ñ " * 40, "alpha beta, gamma."])


def _words(table, texts):
    (_, bounds, data), = gru_lm.text_groups(pa.array(texts))
    return table(bounds, data)


def test_a_word_s_class_is_found_once():
    m = _model()
    table = gru_lm.WordTable(m.trigram, m.frequent)
    texts = ["some words, in a row. x y", "ÄÖ some WORDS, alpha"]
    first = _words(table, texts)
    table.trigram = np.zeros_like(m.trigram)          # found anew, classes would change
    again = _words(table, texts[::-1])
    assert dict(zip(first[0].tolist(), first[2].tolist())) == dict(zip(again[0].tolist(), again[2].tolist()))
    assert not np.array_equal(_words(gru_lm.WordTable(table.trigram, m.frequent), texts)[2], first[2])


def test_words_of_one_slot_keep_their_classes(monkeypatch):
    monkeypatch.setattr(gru_lm, "SLOT_BITS", 2)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcXYZé.,#\x00") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["a" * 5_000]
    m = _model()
    table = gru_lm.WordTable(m.trigram, m.frequent)
    for _ in range(3):
        texts = [rng.choice([" ", "\t", ""]).join(rng.sample(words, 3)) for _ in range(40)] + ["", " "]
        h, row, cls, inp = _words(table, texts)
        own = [w for t in texts for w in t.replace("\t", " ").split(" ") if w]
        assert len(own) == len(h)
        for w, got_h, got_cls, got_inp in zip(own, h, cls, inp):
            b = np.concatenate(([32], table.lower[np.frombuffer(w.encode(), np.uint8)], [32]))
            tri = (b[:-2] * 961 + b[1:-1] * 31 + b[2:]) & (gru_lm.TRIGRAMS - 1)
            want = m.trigram[tri].sum(0).argmax() * gru_lm.ENDINGS + table.ending[w.encode()[-1]]
            at = np.flatnonzero(m.frequent == got_h)
            assert got_cls == want + gru_lm.KINDS * len(at)
            assert got_inp == (gru_lm.CLASSES + at[0] if len(at) else want)


def test_texts_side_by_side_score_as_one_at_a_time():
    rng = random.Random(9)
    m = _model()
    texts = [" ".join(rng.choice(["a", "b", "c.", "q", "é"]) for _ in range(n)) for n in (0, 7, 1, 30, 0, 7, 2, 90)]
    _, row, cls, inp = _words(gru_lm.WordTable(m.trigram, m.frequent), texts)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    got = gru_lm.sequence_scores(m, inp, cls, cut)
    for i in range(len(texts)):
        h, x, total = np.zeros((1, gru_lm.HIDDEN), np.float32), gru_lm.END, 0.0
        for t in range(cut[i], cut[i + 1] + 1):
            g = m.wx[x] + np.concatenate(((h[0] @ m.wh)[:2 * gru_lm.HIDDEN], np.zeros(gru_lm.HIDDEN)))
            z, r = np.split(1 / (1 + np.exp(-g[:2 * gru_lm.HIDDEN])), 2)
            n = np.tanh(g[2 * gru_lm.HIDDEN:] + r * (h[0] @ m.wh[:, 2 * gru_lm.HIDDEN:]))
            h = (n + z * (h[0] - n))[None]
            y = np.exp(h[0] @ m.out + m.bias)
            total += np.log(y[cls[t] if t < cut[i + 1] else gru_lm.END] / y.sum())
            x = inp[t] if t < cut[i + 1] else x
        assert abs(total - got[i]) < 1e-3 * abs(total)
    assert gru_lm.sequence_scores(m, inp[:0], cls[:0], np.zeros(1, int)).size == 0
