"""The filter audit against a row-by-row run of every order."""

import random
import re
from itertools import permutations

import numpy as np
import pytest
from llm_corpus import EXTRA, EXTRA_ROW, docs, no_docs, rows  # noqa: F401

from lendspark.llm import filter_audit as A


def fails(rows):
    """Failed letters of every (id, text) row."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append("".join(c for c, bad in [
            ("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)),
            ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))),
            ("E", i is not None and least[t] < i)] if bad))
    return out


def brute(rows, parts, good, toxic):
    out, shapley = {}, {}
    found = fails(rows)
    for part in set(parts):
        mine = [(i, f) for (i, _), f, p in zip(rows, found, parts) if p == part]
        for order in permutations("ABCDE"):
            left, before = mine, ""
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f and bool(set(f) & set(before)) for _, f in mine),
                    sum(f == x for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                before += x
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(spark, rows, parts, labels, partitions=3):
    docs = spark.createDataFrame([(i, t, p, *EXTRA_ROW) for (i, t), p in zip(rows, parts)],
                                 f"doc_id long, text string, source string, {EXTRA}").repartition(partitions)
    kind = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost,
                                               r.toxic_lost, r.shapley) for r in A.audit(docs, kind).collect()}


def test_every_order_against_brute_force(spark, rows):
    rng = random.Random(3)
    shout = [(100 + k, "LOUD " * rng.randint(1, 60) + " ".join(f"v{rng.randrange(60)}" for _ in range(70))
              + rng.choice(["", " #", " a|b"])) for k in range(30)]
    rows = [*rows, *shout, *[(200 + k, t) for k, (_, t) in enumerate(shout[:11])]]
    parts = [rng.choice(["a", "b", None, "", "rare"]) for _ in rows]
    labels = [(i, int(i % 3 == 0), int(i % 2 == 0)) for i in range(0, 230)] + [(None, 1, 1), (100, None, None), (101, 1, 1), (9999, 1, 1)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    got = audit_rows(spark, rows, parts, labels)
    assert got == brute(rows, [p or "" for p in parts], good, toxic)
    assert any(v[3] for v in got.values()) and any(v[2] for v in got.values())


def test_empty_table(spark, no_docs):
    assert A.audit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_sketch_never_clears_a_repeat(spark, monkeypatch):
    rng = np.random.default_rng(5)
    once, twice = rng.integers(-2 ** 63, 2 ** 63, 40_000), rng.integers(-2 ** 63, 2 ** 63, 500)
    table = spark.createDataFrame([(int(h),) for h in [*once, *twice, *twice]], "h long").repartition(7)
    bits = A.repeat_sketch(table, 41_000)
    assert A.may_repeat(twice, bits).all()
    assert A.may_repeat(once, bits).mean() < 0.05
    monkeypatch.setattr(A, "MAX_CELLS", 1 << 14)          # a sketch far too small: only more suspects
    monkeypatch.setattr(A, "SEGMENT_CELLS", 1 << 14)
    bits = A.repeat_sketch(table, 41_000)
    assert A.may_repeat(twice, bits).all()


@pytest.mark.parametrize("cells", [1 << 4, 1 << 20])
def test_counts_do_not_depend_on_the_sketch(spark, rows, monkeypatch, cells):
    monkeypatch.setattr(A, "MAX_CELLS", cells)
    monkeypatch.setattr(A, "SEGMENT_CELLS", cells)
    parts = ["p"] * len(rows)
    assert audit_rows(spark, rows, parts, []) == brute(rows, parts, set(), set())
