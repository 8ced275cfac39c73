"""The perceptron's training on packed rows: Spark's own numbers, each row multiplied once."""

import numpy as np
import pytest

from lendspark.operators import blocks, models as mdl, perceptron, prep, segment


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(1500, 3)), 2)
    y = ((x ** 2).sum(1) + rng.normal(size=1500) > 3).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(1500)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, a double, b double, c double")
    return segment.to_vector(df, ["a", "b", "c"]).repartition(3, "SK_ID_CURR").cache()


def test_same_model_as_spark_without_copies_of_rows(spark, rings, monkeypatch):
    mlp = mdl.mlp_classifier(3, max_iter=10, hidden=(8, 5), block_size=64)
    want = mlp.fit(mdl.replicate_positives(rings, "TARGET", times=3))
    multiplied = []
    made = perceptron.make_blocks
    monkeypatch.setattr(perceptron, "make_blocks", lambda *a: multiplied.append(made(*a)) or multiplied[0])
    model, history = mdl.fit_mlp(rings, prep.passthrough(), max_iter=10, hidden=(8, 5), block_size=64, pos_weight=3)
    got = model.stages[-1]
    assert history == pytest.approx(list(want.summary().objectiveHistory), rel=1e-9) and len(history) == 11
    assert np.allclose(got.weights.toArray(), want.weights.toArray(), rtol=1e-6, atol=1e-8)
    assert got.getLayers() == want.getLayers() and got.getFeaturesCol() == "features"
    assert sum(blocks.unpack(r.block)[0].shape[1] for r in multiplied[0].collect()) == 1500
    a, b = (mdl.with_probability(m.transform(rings)).orderBy("SK_ID_CURR").select("score").collect() for m in (model, want))
    assert [r.score for r in a] == pytest.approx([r.score for r in b], abs=1e-6)


@pytest.mark.parametrize("batch", [1, 7, 100])
def test_weights_of_stacks(batch):
    rng = np.random.default_rng(batch)
    copies = rng.integers(1, 5, 100)
    every = np.repeat(np.arange(100), copies)              # written out, cut into stacks of 16
    want, n = np.zeros(100), 0
    for s in range(0, len(every), 16):
        np.add.at(want, every[s:s + 16], 1 / len(every[s:s + 16]))
        n += 1
    out = list(perceptron.stack_weights(((copies[s:s + batch], (np.arange(100)[s:s + batch],))
                                         for s in range(0, 100, batch)), 16))
    assert np.allclose(np.concatenate([w for w, _, _ in out]), want) and sum(k for _, _, k in out) == n
    assert np.concatenate([c for _, (c,), _ in out]).tolist() == list(range(100))


def test_blocks_keep_every_bit():
    rng = np.random.default_rng(0)
    x = np.stack([rng.normal(size=3000), np.zeros(3000), rng.integers(0, 2, 3000) * -0.0, rng.integers(0, 9, 3000),
                  rng.integers(0, 700, 3000), np.where(rng.random(3000) < 0.5, np.nan, 1.5),
                  np.r_[np.arange(600) % 5, rng.normal(size=2400)]], axis=1)
    x[:1500, 2] = 0.0
    got, (y,), found = blocks.unpack(blocks.pack(x, x[:, 0], n=5))
    assert got.T.tobytes() == x.tobytes() and y.tobytes() == x[:, 0].tobytes() and found == {"n": 5}


def test_rows_without_a_label_of_two_are_refused(spark, rings):
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F
    with pytest.raises(PythonException, match="0 or 1"):
        mdl.fit_mlp(rings.withColumn("TARGET", F.col("SK_ID_CURR") % 3), prep.passthrough(), hidden=(4,), max_iter=2)
