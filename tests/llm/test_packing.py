import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer
from llm_corpus import docs, no_docs, rows  # noqa: F401

from lendspark.llm import packing
from lendspark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


def check(got, rows, tok, window):
    want = sorted(((str(i), t) for i, t in rows), key=str)
    ids = defaultdict(list)
    for i, t in want:
        ids[i].append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[str(r.doc_id)].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, docs in ids.items():
        expected = defaultdict(int)
        for r in pieces[i]:
            crcs = {zlib.crc32(np.array(d[r.start:r.start + r.length], "<u4").tobytes())
                    for d in docs if len(d) == r.doc_tokens}
            assert r.ids_crc32 in crcs
            expected[r.doc_tokens] += r.length
        assert sum(expected.values()) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    for spans in seqs.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= window
    total = sum(map(len, (d for v in ids.values() for d in v)))
    return total / (window * len(seqs))


def test_round_trip_with_awkward_texts(spark, docs, rows, tok):
    fill = check(packing.pack(docs, tokenizer_path()).collect(), rows, tok, 4096)
    assert fill > 0.95


def test_all_long_documents_are_cut(spark, tok):
    rows = [(i, " ".join(f"w{(i * 7919 + k * 31) % 97}" for k in range(900))) for i in range(60)]
    fill = check(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()).collect(), rows, tok, 4096)
    assert fill > 0.9


def test_empty_table(spark, no_docs):
    assert packing.pack(no_docs, tokenizer_path()).collect() == []


def test_nnls_matches_optimality_conditions():
    rng = np.random.default_rng(0)
    a, h = packing.combinations(16), rng.random(16)
    x = packing.nnls(a, h)
    g = a.T @ (h - a @ x)
    assert (x >= 0).all() and g.max() < 1e-6 and abs(g[x > 0]).max() < 1e-6


def test_crc_of_tail():
    a, b = b"some head bytes", b"and a longer tail \x00\x01"
    assert packing.crc_of_tail(zlib.crc32(a + b), zlib.crc32(a), len(b)) == zlib.crc32(b)
    assert packing.crc_of_tail(zlib.crc32(a), zlib.crc32(a), 0) == 0


def test_word_ids_equal_the_tokenizers(tok):
    ids = packing.DocumentIds(open(tokenizer_path()).read())
    for t in ["It's we'll 12a a1 ÉÈ Straße, İstanbul naïve e\u0301a ΣΑΣ <|endoftext|> x<|startoftext|>y",
              "a\u00a0b\u2003c\x1cd \u3000 ---... 'S 'tis don't!? ½ ² ǅ ﬁ", "a" * 5000, " \n"]:
        assert ids(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
