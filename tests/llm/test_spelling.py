"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_corpus import docs, frame, no_docs, rows  # noqa: F401

from lendspark.llm import spelling as S


def near(v, w):
    if abs(len(v) - len(w)) > 1 or v == w:
        return False
    if len(v) == len(w):
        return sum(a != b for a, b in zip(v, w)) == 1
    short, long = sorted((v, w), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute(rows, least=6, count=5):
    c = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    c = {w: n for w, n in c.items() if len(w) >= least and n >= count}
    out = {}
    for w, n in c.items():
        friends = sorted((-c[v], v) for v in c if near(v, w))
        form = friends[0] if friends and -friends[0][0] >= 5 * n else None
        out[w] = [n, len(friends), form and form[1], form and -form[0], None]
    for w, v in out.items():
        r = w
        while out[r][2]:
            r = out[r][2]
        v[4] = r
    return {w: tuple(v) for w, v in out.items()}


def result(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def variants(seed, k, stems=("spelling", "variété", "Ärgerniße", "common", "aaaaaa", "abababa")):
    rng = random.Random(seed)
    letters = "abeséß×ÿ"
    words = []
    for _ in range(k):
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.randrange(len(w) + 1)
            w = rng.choice([w[:p] + rng.choice(letters) + w[p:], w[:p] + w[p + 1:],
                            w[:p] + rng.choice(letters) + w[p + 1:]])
        words.append(w)
    return words


def test_variants_against_brute_force(spark, rows):
    rng = random.Random(2)
    words = [w for w in variants(1, 400) if w]
    more = [(1000 + i, rng.choice(["", "Ā€", "x1 "]) + " ".join(
        rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=300))) for i in range(60)]
    rows = [*rows, *more, (None, more[0][1]), (2000, "longrun" * 9000), *[(3000 + i, "q" * 70 + " same") for i in range(6)]]
    want = brute(rows)
    assert result(S.spelling_variants(frame(spark, rows).repartition(5))) == want
    assert sum(v[2] is not None for v in want.values()) > 20 and any(
        v[2] and want[v[2]][2] for v in want.values())          # chains of forms occur


def test_hot_states_are_split(spark, monkeypatch):
    """A limit of few words a state: successor states and joins give the same pairs."""
    words = sorted({w.lower() for w in variants(7, 900) if len(w) >= 6})
    table = spark.createDataFrame([(w, 1 + k % 7) for k, w in enumerate(words)], "word string, n long")
    count = {w: 1 + k % 7 for k, w in enumerate(words)}
    want = sorted((v, w, count[w]) for v in words for w in words if near(v, w))
    for limit in (20_000, 8):
        monkeypatch.setattr(S, "GROUP", limit)
        assert sorted(map(tuple, S.near_pairs(table, 3).collect())) == want


def test_long_words(spark):
    """Words around and over the length that is read one code point at a time."""
    rng = random.Random(5)
    words = set()
    for size in (255, 256, 257, 258, 300, 384, 511, 900, 3000):
        w = "".join(rng.choices("abcé", k=size))
        words.add(w)
        for p in (0, 1, 127, 128, 129, size // 2, size - 129, size - 1):
            words |= {w[:p] + w[p + 1:], w[:p] + "z" + w[p:], w[:p] + "z" + w[p + 1:], w + "a"}
    words = sorted(words)
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = sorted((v, w, 3) for v in words for w in words if near(v, w))
    assert sorted(map(tuple, S.near_pairs(table, 3).collect())) == want


@pytest.mark.parametrize("alphabet,size", [("ab", 4), ("abc", 5), ("aé", 6)])
def test_composition_gives_each_pair_once(alphabet, size):
    rng = random.Random(size)
    words = sorted({"".join(rng.choices(alphabet, k=rng.randint(0, size))) for _ in range(60)})
    got = [tuple(sorted(p)) for p in S.one_edit_pairs(words)]
    assert sorted(got) == sorted((v, w) for v in words for w in words if v < w and near(v, w))


def test_acceptor_is_minimal():
    words = sorted(a + b + c for a in "abcd" for b in ("x", "yy") for c in ("ing", "ed", ""))
    a = S.Acceptor(words)
    assert len(a.edges) == 8            # start, a|x, a|y, after the stem, three inside the ends, end

    def accepted(state, prefix):
        out = [prefix] if a.final[state] else []
        return out + [w for c, x in a.edges[state].items() for w in accepted(x, prefix + c)]
    assert sorted(accepted(a.start, "")) == words


def test_crc32():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + rng.integers(0, 200, 300)
    seed = rng.integers(0, 2 ** 32, 300, dtype=np.uint32)
    got = S.crc32_of(data, start, end, seed)
    assert got.tolist() == [zlib.crc32(data[s:e].tobytes(), int(c)) for s, e, c in zip(start, end, seed)]


def test_empty_table_and_no_words(spark, no_docs):
    assert S.spelling_variants(no_docs).collect() == []
    assert S.spelling_variants(frame(spark, [(1, "a b c"), (2, None)])).collect() == []
