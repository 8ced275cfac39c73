import random

import pytest
from llm_corpus import docs, frame, no_docs, rows  # noqa: F401

from lendspark.llm import decontaminate as D


def distance(p, s):
    """Least edit distance of p to a substring of s."""
    row = [0] * (len(s) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(s, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(1)
    for _ in range(200):
        p, s = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 80))) for _ in range(2))
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        assert D.myers(masks, len(p), s)[0] == distance(p, s)


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 300])
def test_leaks_against_brute_force(spark, monkeypatch, rows, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    items = [(i, text(rng.randint(30, 120))) for i in range(12)] + [(90, None), (91, "..."), (92, ""), (93, "Tiny Text"),
                                                                  (94, "Tiny Text"), (None, "x"), (95, rows[0][1])]
    data = [(i, t) for i, t in rows if len(t or "") < 2000]
    for i in range(40):
        t = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(len(t))
            t[k:k + 1] = rng.choice([[], ["z"], [t[k], "y"]])
        data.append((1000 + i, text(60) + " " + "".join(t).upper() + "! " + text(60)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.edits) for r in D.find_leaks(frame(spark, data), bench).collect())
    want = []
    for i, t in data:
        for k, x in items:
            a, b = D.normalize(x or ""), D.normalize(t or "")
            if k is not None and a and b and (d := distance(a, b)) <= int(D.RATE * len(a)):
                want.append((str(i), k, d))
    assert got == sorted(want)
    kept = D.drop_leaks(frame(spark, data), bench)
    bad = {i for i, _, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in data if not any(
        D.normalize(x or "") and distance(D.normalize(x or ""), D.normalize(t or "")) <= int(D.RATE * len(D.normalize(x or "")))
        for k, x in items if k is not None and t))
    assert bad


def test_empty(spark, docs, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(docs, bench).collect() == [] and D.find_leaks(no_docs, bench).collect() == []
    assert D.drop_leaks(docs, bench).count() == docs.count()
