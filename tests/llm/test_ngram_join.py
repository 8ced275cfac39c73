import random

import numpy as np
import pyarrow as pa
import pytest
from llm_corpus import docs, frame, no_docs, rows  # noqa: F401

from lendspark.llm import ngram_join as J
from lendspark.llm.components import components


def shingles(text, n):
    w = (text or "").encode().lower().split()
    if len(w) >= n:
        return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def brute(rows, n, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for x in range(len(sets)):
        for y in range(x):
            (a, s), (b, t) = sets[x], sets[y]
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                r, q = find(a), find(b)
                root[max(r, q)] = min(r, q)
    # an id with several texts: the component of a row is that of its text
    out = []
    for i, s in sets:
        if i is None or not s:
            out.append((i, len(s), i))
        else:
            same = [find(j) for j, t in sets if j is not None and t and 100 * len(s & t) >= percent * len(s | t)]
            out.append((i, len(s), min(same)))
    return sorted(out, key=str)


def test_awkward_rows_against_brute_force(spark, docs, rows):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.shingle_join(docs).collect()]
    assert sorted(got, key=str) == brute(rows, 4, 85)


@pytest.mark.parametrize("percent,frequent", [(85, 8192), (80, 2), (60, 3)])
def test_chains_and_frequent_tokens(spark, monkeypatch, percent, frequent):
    """Groups around the threshold, chains, and (few sets make a token frequent)
    token combinations in the prefixes."""
    monkeypatch.setattr(J, "FREQUENT", frequent)
    rng = random.Random(percent)
    rows, k = [], 0
    for g in range(12):
        base = [f"g{g % 9}x{j}" for j in range(rng.choice([5, 7, 9, 16, 33, 60, 140]))]
        for _ in range(rng.randint(1, 9)):
            k += 1
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10 ** 6)}"
            base = w if rng.random() < 0.5 else base
            rows.append((k, " ".join(w)))
    got = [(r.doc_id, r.n_shingles, r.component_id)
           for r in J.shingle_join(frame(spark, rows), percent=percent).collect()]
    assert sorted(got, key=str) == brute(rows, 4, percent)


@pytest.mark.parametrize("words,percent,frequent", [(4, 85, 8192), (5, 80, 8192), (4, 60, 8192), (4, 85, 2)])
def test_short_texts_with_one_word_more(spark, monkeypatch, words, percent, frequent):
    """A set of m tokens links with one of m + 1 that holds it."""
    monkeypatch.setattr(J, "FREQUENT", frequent)
    rows = []
    for m in range(1, 14):
        for side in range(2):
            base = [f"m{m}s{side}x{j}" for j in range(m + words - 1)]
            more = base + ["tail"] if side else ["head"] + base
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(more))]
    got = [(r.doc_id, r.n_shingles, r.component_id)
           for r in J.shingle_join(frame(spark, rows), words=words, percent=percent).collect()]
    assert sorted(got, key=str) == brute(rows, words, percent)


@pytest.mark.parametrize("frequent_share", [0.0, 0.5, 0.9, 1.0])
def test_similar_sets_share_a_signature(frequent_share):
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(7, 300))
        universe = rng.integers(0, 2 ** 63, 2 * n, dtype=np.uint64)
        freq = np.unique(universe[rng.random(2 * n) < frequent_share] & J.LOW)
        level = rng.integers(3, 9, len(freq)).astype(np.int8)
        cut = int(0.075 * n)
        a, b = np.unique(universe[:n]), np.unique(universe[cut:n + cut // 2])
        k = len(np.intersect1d(a, b))
        if 100 * k < 85 * (len(a) + len(b) - k):
            continue
        (x, cap_x), (y, cap_y) = (J.prefix_signatures(s, len(s) - (-(-85 * len(s) // 100)) + 1, 85, freq, level)
                                  for s in (a, b))
        both, i, j = np.intersect1d(x, y, return_indices=True)
        assert len(both), (n, len(a), len(b))
        # some shared signature is left by the caps, and no member of it is dropped
        fits = 185 * np.minimum(cap_x[i], cap_y[j]) >= 85 * (len(a) + len(b))
        assert fits.any()
        sig = np.concatenate((x[i][fits], y[j][fits]))
        size = np.repeat([len(a), len(b)], fits.sum())
        assert J._can_link(sig, size, np.concatenate((cap_x[i][fits], cap_y[j][fits])), 85).all()


def test_members_without_a_partner(percent=85):
    rng = np.random.default_rng(1)
    for _ in range(200):
        m = int(rng.integers(2, 30))
        group = np.sort(rng.integers(0, 4, m)).astype(np.uint64)
        n = rng.integers(50, 120, m)
        cap = (n * rng.uniform(0.7, 1, m)).astype(np.int64)
        got = J._can_link(group, n, cap, percent)
        for x in range(m):
            for y in range(m):
                if x != y and group[x] == group[y] and 185 * min(cap[x], cap[y]) >= 85 * (n[x] + n[y]):
                    assert got[x] and got[y]


@pytest.mark.parametrize("own", [0.12, 0.2])
def test_template_documents_that_do_not_link(own):
    """Texts of 1,500 words that share most of a template and link with none: no postings
    stay, whatever their number."""
    for k in (100, 300):
        rng = random.Random(k)
        base = [f"t{i}" for i in range(1500)]
        texts = [" ".join([*base[:int(1500 * (1 - own))], *(f"o{d}x{i}" for i in range(int(1500 * own)))])
                 for d in range(k)]
        rng.shuffle(texts)
        batch = pa.record_batch([pa.array(texts)], names=["t"])
        sets = dict(J.ShingleSets(4)(batch.column(0)))
        token, count = np.unique(np.concatenate(list(sets.values())) & J.LOW, return_counts=True)
        freq, level = token[count >= 8], np.log2(count[count >= 8] + 1.0).astype(np.int8)
        posted = pa.Table.from_batches(list(J._post(4, 0, 85, freq, level, 1)([batch])))
        assert posted.num_rows and J._live(85)(posted).num_rows == 0


def test_wide_sketches_separate_members():
    """Members of one signature with sizes and caps that fit, but other tokens."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 1400, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base, rng.integers(0, 2 ** 63, 200, dtype=np.uint64)))) for _ in range(60)]
    sets += [np.unique(np.concatenate((sets[0][:-4], rng.integers(0, 2 ** 63, 4, dtype=np.uint64))))]
    sets += [base[:100]]                                               # one small member widens nothing
    n = np.array([len(s) for s in sets])
    for m in (61, 62):
        table = pa.table({"sig": np.zeros(m, np.int64), "key": np.arange(m), "n": n[:m], "cap": n[:m],
                          "comp": np.arange(m), "links": np.ones(m, np.int64),
                          "sketch": pa.array([J.sketch(s) for s in sets[:m]], pa.binary())})
        got = J._candidates(85, None, False)(table)
        pairs = set(zip(got.column("a").to_pylist(), got.column("b").to_pylist()))
        assert (0, 60) in pairs and len(pairs) < 10
        few = J._candidates(85, 1, False)(table)
        assert few.num_rows == len(pairs) and not any(few.column("more").to_pylist())


@pytest.mark.parametrize("postings,table", [(0, 10 ** 8), (1, 10 ** 8), (300, 10 ** 8), (300, 5)])
def test_pairs_between_components(postings, table):
    rng = np.random.default_rng(postings)
    sets = 40
    n, comp = rng.integers(60, 110, sets), rng.integers(0, 6, sets)
    seen = np.unique(np.stack((rng.integers(0, 12, postings), rng.integers(0, sets, postings)), 1), axis=0)
    group, row = seen[:, 0], seen[:, 1]
    cap = (n[row] * rng.uniform(0.85, 1, len(row))).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(group) else np.zeros(1, np.int64)
    found = J.PairSet(sets, table)
    for x, y in J._cross_pairs(cut, row, n, cap, comp, 85):
        found.add(x, y)
    want = {(max(row[a], row[b]), min(row[a], row[b])) for a in range(len(row)) for b in range(a)
            if group[a] == group[b] and comp[row[a]] != comp[row[b]]
            and 100 * min(n[row[a]], n[row[b]]) >= 85 * max(n[row[a]], n[row[b]])
            and 185 * min(cap[a], cap[b]) >= 85 * (n[row[a]] + n[row[b]])}
    assert set(zip(*(v.tolist() for v in found.pairs()))) == want


def test_connected_members_are_not_held_against_each_other():
    comp = np.zeros(200_000, np.int64)
    comp[:3] = [1, 2, 3]
    n = np.full(200_000, 50)
    pairs = J._cross_pairs(np.array([0, 200_000]), np.arange(200_000), n, n, comp, 85)
    assert sum(len(x) for x, _ in pairs) == 3 * 199_997 + 3


def test_sketch_distances_of_different_widths():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2 ** 63, int(k), dtype=np.uint64)) for k in rng.integers(1, 3000, 40)]
    marks = [J.sketch(s) for s in sets]
    i, j = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    want = [int(J.POPCOUNT[J.folded(marks[a], w) ^ J.folded(marks[b], w)].sum())
            for a, b in zip(i, j) for w in [min(len(marks[a]), len(marks[b]))]]
    assert J.Sketches(marks).distance(i, j).tolist() == want


def test_drop_near_copies(spark, docs, rows):
    kept = J.drop_near_copies(docs, words=5, percent=80)
    assert kept.columns == docs.columns
    got = [(str(r.doc_id), r.text) for r in kept.collect()]
    comp = brute(rows, 5, 80)
    want = set()
    for (i, t) in rows:
        c = next(c for j, n, c in comp if j == i and n == len(shingles(t, 5)))
        if i is None or not shingles(t, 5) or c == i:
            want.add((str(i), t))
    assert set(got) == want
    assert sum(r == ("50", next(t for i, t in rows if i == 50)) for r in got) == 1


def test_empty_and_components(spark, no_docs):
    assert J.shingle_join(no_docs).collect() == []
    assert J.drop_near_copies(no_docs).collect() == []
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in (100, 101, 102)} == {100}
