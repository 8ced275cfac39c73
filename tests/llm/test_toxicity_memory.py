import gc

import numpy as np

from lendspark.llm import toxicity


def test_scorer_ends_with_its_last_reference():
    scorer = toxicity.Scorer(toxicity.Model())
    scorer(["some words of a text"])
    gc.collect()
    gc.disable()
    try:
        del scorer
        assert not any(isinstance(x, toxicity.Scorer) for x in gc.get_objects())
    finally:
        gc.enable()


def test_scorer_keeps_a_bounded_table(monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(40)] + ["", "w0x1 w0x2"]
    whole = toxicity.Scorer(toxicity.Model())(texts)
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 1000)
    monkeypatch.setattr(toxicity, "SLICE", 500)
    scorer, most = toxicity.Scorer(toxicity.Model()), 0
    for t in texts:
        scorer([t])
        most = max(most, len(scorer.table))
    assert most <= 1000 + 2 * 500 and len(scorer.index) <= 1000 + 2 * 500
    assert np.allclose(scorer(texts), whole, rtol=1e-6)


def test_texts_are_taken_one_at_a_time(monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", 50)
    texts = [f"word{i} and so on" for i in range(60)] + ["", "x " * 300]
    scorer, held = toxicity.Scorer(toxicity.Model()), []
    pool = scorer._pool
    monkeypatch.setattr(scorer, "_pool", lambda parts, best: (held.append(given[-1]), pool(parts, best)))
    given = []
    got = scorer((given.append(i) or t for i, t in enumerate(texts)), len(texts))
    assert held[0] < 10 and len(got) == len(texts)       # pooled before the later texts are there
    assert np.allclose(got, toxicity.Scorer(toxicity.Model())(texts), rtol=1e-6)
    assert len(toxicity.Scorer(toxicity.Model())(iter(()), 0)) == 0
