"""op10: the network learns from all words of all training documents."""

import random

import numpy as np
import pyarrow as pa
from llm_corpus import frame
from pyspark.sql import functions as F

from lendspark.llm import gru_lm


def test_all_training_documents_are_learned_from(spark):
    rng = random.Random(6)
    docs = frame(spark, [(i, " ".join(rng.choice(["ab", "cd.", "ef", "gh,"]) for _ in range(30))) for i in range(60)])
    start = gru_lm.train(docs, F.lit(True), "doc_id", "text", 10, 500)
    got = gru_lm.refine(start, docs, F.lit(True), "doc_id", "text")
    whole = gru_lm.refine(start, docs, F.lit(True), "doc_id", "text", one_in=1)
    assert np.allclose(got.wx, whole.wx) and not np.allclose(got.wx, start.wx)


def test_a_shard_is_learned_from_to_its_last_word():
    m = gru_lm.fit(["a b c d"])
    texts = ["a b c d " * 25_000] * 11
    t = pa.table({"t": texts, "o": list(range(11)), "shard": [0] * 11})
    assert gru_lm._learn_shard(m.to_bytes(), 0.002)(t).column("tokens")[0].as_py() == 11 * 100_001
