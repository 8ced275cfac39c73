import hashlib
import random

import numpy as np
import pytest
from llm_corpus import docs, frame, no_docs, rows  # noqa: F401

from lendspark.llm import suffix_dedup as S
from lendspark.llm.suffix_dedup import remove_repeats
from lendspark.llm.suffix_sort import suffix_order


def brute(rows, length):
    seen, dup = set(), set()
    for _, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            x = b[s:s + length]
            (dup if x in seen else seen).add(x)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cov = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in dup:
                cov[s:s + length] = True
        spans = int((cov[1:] < cov[:-1]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~cov[:-1]])
        out.append((i, len(b), int(cov.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_awkward_rows(docs, rows):
    assert sorted(map(tuple, remove_repeats(docs).collect()), key=str) == brute(rows, 200)


@pytest.mark.parametrize("length", [40, 90, 200])
def test_random_repeats(spark, length):
    rng = random.Random(length)
    pool = ["".join(rng.choice("ab \n") for _ in range(rng.randint(length // 2, 3 * length))) for _ in range(8)]
    pool += ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(length // 2, 3 * length))) for _ in range(8)]
    pool += ["a" * (2 * length), "ab" * length, "", "\x00" * length + "b"]
    rows = []
    for i in range(60):
        parts = [rng.choice(pool)[rng.randint(0, 20):] for _ in range(rng.randint(0, 4))]
        parts.insert(0, "".join(rng.choice("xyzw") for _ in range(rng.randint(0, 30))))
        rows.append((i, "".join(parts)))
    got = remove_repeats(frame(spark, rows).repartition(3), length=length).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


@pytest.mark.parametrize("hot", [2, 20])
def test_hot_passage(spark, monkeypatch, hot):
    """Hot anchors and contexts are split: same result, and no group of contexts
    grows with the documents that hold a passage."""
    monkeypatch.setattr(S, "HOT", hot, raising=False)
    monkeypatch.setattr(S, "FEW", 1, raising=False)
    compare = S._compare

    def bounded(length, gram):
        run = compare(length, gram)

        def check(table):
            _, n = np.unique(table.column("anchor").to_numpy(), return_counts=True)
            assert n.max() < hot, f"{n.max()} contexts of one anchor in a group"
            return run(table)
        return check

    monkeypatch.setattr(S, "_compare", bounded)
    rng = random.Random(hot)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, copy = word(500), word(700)
    rows = [(i, word(rng.randint(0, 300)) + passage + word(rng.randint(0, 300))) for i in range(60)]
    rows += [(100 + i, copy) for i in range(40)] + [(200, copy[:450] + word(300)), (201, word(900))]
    got = remove_repeats(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 200)


def test_passage_spread_thinly_over_many_slices(spark, monkeypatch):
    """Seven texts a slice hold a passage, in 80 slices: its anchors are found hot, and no
    group of contexts has more than the limit."""
    monkeypatch.setattr(S, "HOT", 50)
    compare = S._compare

    def bounded(length, gram):
        run = compare(length, gram)

        def check(table):
            _, n = np.unique(table.column("anchor").to_numpy(), return_counts=True)
            assert n.max() < 50, f"{n.max()} contexts of one anchor in a group"
            return run(table)
        return check

    monkeypatch.setattr(S, "_compare", bounded)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = word(400)
    rows = [(i, word(rng.randint(0, 120)) + passage + word(rng.randint(0, 120))) for i in range(560)]
    got = remove_repeats(frame(spark, rows).repartition(80)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 200)


def test_counts_by_samples():
    """Anchors that every slice has a few times are estimated from one in 7 slices."""
    import pyarrow as pa
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, total = word(400), {}
    for i in range(400):
        batch = pa.record_batch({"text": np.array([rng.getrandbits(62) for _ in range(6)]),
                                 "t": pa.array([word(80) + passage + word(80) for _ in range(6)])})
        for out in S._crowded(200, 64, 8, 7)([batch]):
            for kind, h, n in zip(*(c.to_pylist() for c in out.columns)):
                if kind == 0:
                    total[h] = total.get(h, 0) + n
    top = sorted(total.values(), reverse=True)
    assert 1200 < top[0] < 4800 and top[1] > 1200 and sum(v > 1000 for v in total.values()) < 12


def test_copies_of_a_text_send_two(spark):
    import pyarrow as pa
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(900))
    one, many = ([pa.record_batch({"text": np.full(n, 7), "t": pa.array([text] * n)})] for n in (1, 500))
    a, b = (sum(len(c[0]) for c in S._occurrences(200, 64, x)) for x in (one, many))
    assert b == 2 * a > 0


def test_empty(no_docs):
    assert remove_repeats(no_docs).collect() == []


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_order(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    assert len(suffix_order(np.zeros(0, np.int64))) == 0
