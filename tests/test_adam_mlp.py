"""Minibatch Adam: gradients, one shard against plain numpy, several shards averaged."""

import numpy as np
import pytest

from lendspark.operators import adam_mlp as A, evaluate as ev, segment


def numpy_adam(net, x, y, order_of, epochs, batch, rate, pos_weight):
    w, m, v, t, history = net.w.copy(), 0.0, 0.0, 0, []
    for e in range(epochs):
        o, total = order_of(e), 0.0
        for s in range(0, len(o), batch):
            k = o[s:s + batch]
            loss, g = A.Network(net.sizes[:-1], w).loss_and_gradient(x[k], y[k], pos_weight)
            total += loss * len(k)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        history.append(total / len(o))
    return w, history


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    net, x, y = A.Network([3, 5, 4], seed=2), rng.normal(size=(30, 3)), rng.integers(0, 2, 30).astype(float)
    _, g = net.loss_and_gradient(x, y, 3.0)
    for k in range(0, len(net.w), 5):
        up, down = (A.Network(net.sizes[:-1], net.w + d * np.eye(1, len(net.w), k)[0]).loss_and_gradient(x, y, 3.0)[0]
                    for d in (1e-6, -1e-6))
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


@pytest.fixture(scope="module")
def circles(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 2))
    y = ((x ** 2).sum(1) > 2).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(700)] + [(900, None, 0.0, 0.0)]
    return segment.to_vector(spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, a double, b double"), ["a", "b"]).cache()


def test_one_shard_is_plain_adam_and_shards_learn(spark, circles):
    args = dict(hidden=(16, 8), epochs=6, batch=64, rate=0.01, pos_weight=2.0)
    model = A.fit_adam_mlp(circles, **args)
    from pyspark.sql import functions as F
    rows = circles.where("TARGET IS NOT NULL").select(F.xxhash64("SK_ID_CURR", F.lit(42)).alias("k"), "TARGET", "a", "b").orderBy("k").collect()
    x, y = np.array([(r.a, r.b) for r in rows]), np.array([float(r.TARGET) for r in rows])
    w, history = numpy_adam(A.Network([2, 16, 8]), x, y, lambda e: np.random.default_rng([e, 0]).permutation(len(y)),
                            6, 64, 0.01, 2.0)
    assert np.allclose(model.net.w, w) and model.history == pytest.approx(history)
    sharded = A.fit_adam_mlp(circles, **{**args, "epochs": 12, "batch": 16}, shard_rows=200)
    again = A.fit_adam_mlp(circles, **{**args, "epochs": 12, "batch": 16}, shard_rows=200)
    assert np.allclose(sharded.net.w, again.net.w) and sharded.history[-1] < 0.75 * sharded.history[0]
    for m in (model, sharded):
        scored = m.score(circles.where("TARGET IS NOT NULL"))
        assert ev.evaluate(scored, "TARGET", "score").first().auc_roc > 0.9
    with pytest.raises(ValueError):
        A.fit_adam_mlp(circles.where("TARGET IS NULL"))
