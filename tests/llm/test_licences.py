"""The licence scan against brute force."""

import random
import re

import pytest
from llm_corpus import docs, frame, no_docs, rows  # noqa: F401

from lendspark.llm import licences as L


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def places(text):
    w = words_of(text)
    out = []
    for label, phrase in L.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return sorted(out)


def test_matching_statistics_against_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        texts = [" ".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(4)] + ["c d c", "d c"]
        a = L.TemplateAutomaton([("p", "a b"), ("q", "b"), ("r", "c d")], [(str(k), t) for k, t in enumerate(texts)])
        strings = [t.encode().split() for t in texts]
        runs = {tuple(s[i:j]) for s in [*strings, [b"a", b"b"]] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        doc = rng.choices([b"a", b"b", b"c", b"d", b"x"], k=60)
        for i, (state, n) in enumerate(a.statistics(doc)):
            longest = max((m for m in range(i + 2) if m == 0 or tuple(doc[i + 1 - m:i + 1]) in runs))
            assert n == longest
            run = doc[i + 1 - n:i + 1]
            if n:
                assert a.ends[state] == [(t, e) for t, s in enumerate(strings) for e in range(n, len(s) + 1)
                                         if s[e - n:e] == run]
            ended = sorted(p for p, w in (("p", [b"a", b"b"]), ("q", [b"b"]), ("r", [b"c", b"d"]))
                           if doc[max(0, i + 1 - len(w)):i + 1] == w)
            assert sorted(p for p, size in a.phrases[state] if n >= size) == ended


def test_whole_rows_against_brute_force(spark, rows):
    rng = random.Random(1)
    parts = ["MIT License", "mit", "license", "the Apache\nLicense,", "general public", "General-Public License",
             "MIT_LICENSE", "mit licenses", "gnu", "word", "été license", "mit license", "a", "of"]
    more = [(100 + i, " ".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(60)]
    more += [(200, "MIT LICENSE " * 30_000), (201, "mit"), (202, "license"), (None, "mit license"), (203, "mit.license")]
    rows = [*rows, *more]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
           for r in L.licence_digest(L.find_licences(frame(spark, rows).repartition(4))).collect()}
    want = set()
    for i, t in rows:
        p = places(t)
        want.add((i, len(words_of(t)), len(p), p[0][0] if p else None, p[-1][0] if p else None,
                  ",".join(sorted({x for _, x in p}))))
    assert got == want


def test_spans(spark):
    body = dict(enumerate(t for _, t in L.TEMPLATES))
    mit, bsd = body[0].split(), next(t for n, t in L.TEMPLATES if n == "bsd").split()
    noise = ["plain", "words"] * 30
    edited = [w if k % 9 else "changed" for k, w in enumerate(mit)]
    texts = [" ".join(noise + mit + noise), " ".join(edited), " ".join(mit[:20]), " ".join(noise + bsd + bsd + noise),
             " ".join(mit[30:] + noise + mit[:30]), "Licensed under CC BY-NC 4.0.", " ".join(noise),
             " ".join(reversed(mit)), "\n".join([" ".join(bsd)] * 400)]
    out = {r.doc_id: r for r in L.find_licences(frame(spark, list(enumerate(texts)))).collect()}
    spans = {i: [(s.label, s.start, s.end, round(s.share, 2)) for s in r.spans] for i, r in out.items()}
    n_mit, n_bsd = len(words_of(body[0])), len(words_of(" ".join(bsd)))
    assert spans[0] == [("mit", 60, 60 + n_mit, 1.0)]
    assert len(spans[1]) == 1 and spans[1][0][0] == "mit" and 0.6 <= spans[1][0][3] < 1
    assert spans[2] == [] and spans[4] == [] and spans[6] == [] and spans[7] == []
    assert spans[3] == [("bsd", 60, 60 + n_bsd, 1.0), ("bsd", 60 + n_bsd, 60 + 2 * n_bsd, 1.0)]
    assert spans[5] == [("cc-by-nc", 0, 7, 1.0)]
    assert len(spans[8]) == 400
    digest = {r.doc_id: r for r in L.licence_digest(L.find_licences(frame(spark, list(enumerate(texts))))).collect()}
    assert digest[5].labels == "cc-by-nc" and digest[5].base_labels == "" and digest[5].score == 1.0
    assert digest[0].labels == "mit" and digest[6].score == 0.0 and digest[6].labels == ""


def test_empty_table_and_bad_templates(spark, no_docs):
    assert L.find_licences(no_docs).collect() == []
    with pytest.raises(ValueError):
        L.TemplateAutomaton([("x", "...")], [])
