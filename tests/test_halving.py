"""Successive halving: sizes, promotion, repeatability, and the result at equal work."""

import numpy as np
import pytest

from lendspark.operators import halving as H, models as mdl, prep, segment


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 6))
    y = (x[:, 0] - 0.7 * x[:, 1] + rng.normal(size=900) > 0.4).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(900)] + [(5000, None, *[0.0] * 6)]
    cols = [f"x{k}" for k in range(6)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, " + ", ".join(f"{c} double" for c in cols))
    return segment.to_vector(df, cols).select("SK_ID_CURR", "TARGET", "features").cache()


def test_rung_sizes():
    assert H.rung_sizes(9, 3, 3) == [(9, pytest.approx(1 / 9)), (3, pytest.approx(1 / 3)), (1, 1.0)]
    assert [n for n, _ in H.rung_sizes(5, 2, 3)] == [5, 3, 2]


def test_halving_against_full_fits(data):
    space = {"logistic_regression": {"regParam": ("loguniform", 1e-6, 50.0), "elasticNetParam": ("uniform", 0.0, 1.0)}}
    candidates = H.draw_candidates(space, 9)
    best, history = H.successive_halving(data, prep.passthrough(), candidates)
    rows = history.orderBy("rung", "candidate").collect()
    assert [sum(r.rung == k for r in rows) for k in range(3)] == [9, 3, 1]
    for rung in range(3):
        here = [r for r in rows if r.rung == rung]
        assert min(r.auc_roc for r in here if r.promoted) >= max((r.auc_roc for r in here if not r.promoted), default=0)
    n = [max(r.n_train for r in rows if r.rung == k) for k in range(3)]
    assert n[2] == 720 and abs(n[0] - 80) <= 1 and abs(n[1] - 240) <= 1
    again, second = H.successive_halving(data, prep.passthrough(), candidates)
    assert again[:3] == best[:3] and second.orderBy("rung", "candidate").collect() == rows
    # equal work in rows: 9/9 + 3/3 + 1 = three full fits, tried in turn
    turn = mdl.budgeted_search(data.where("TARGET IS NOT NULL"), prep.passthrough(), space, time_budget_s=None, max_trials=3)
    assert best[2] >= turn[2] - 0.005          # the better half of the draws differ by less
    assert best[3].transform(data).count() == 901
    with pytest.raises(ValueError):
        H.successive_halving(data, prep.passthrough(), [])
