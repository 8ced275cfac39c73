"""Exact small-sample p-values against enumeration of all orders."""

from itertools import combinations
from math import comb

import numpy as np
import pytest

from lendspark.functions import tails
from lendspark.operators import hypothesis as hyp


def orders(n0, n1):
    """(U of class 0, KS * n0 * n1) of every order of the two classes."""
    for ones in combinations(range(n0 + n1), n1):
        u = i = j = d = 0
        for k in range(n0 + n1):
            if k in ones:
                j += 1
            else:
                i += 1
                u += j
            d = max(d, abs(i * n1 - j * n0))
        yield u, d


@pytest.mark.parametrize("n0,n1", [(1, 1), (1, 6), (3, 4), (5, 5), (7, 3), (2, 9)])
def test_exact_p_by_enumeration(n0, n1):
    all_orders = list(orders(n0, n1))
    assert tails.u_counts(n0, n1) == [sum(u == k for u, _ in all_orders) for k in range(n0 * n1 + 1)]
    for u in {u for u, _ in all_orders}:
        top = max(u, n0 * n1 - u)
        want = min(1.0, 2 * sum(v >= top for v, _ in all_orders) / len(all_orders))
        assert tails.mann_whitney_p(u, n0, n1, 0) == pytest.approx(want)
    for d in {d for _, d in all_orders}:
        want = sum(e >= d for _, e in all_orders) / len(all_orders)
        assert tails.ks_2samp_p(d / (n0 * n1), n0, n1) == pytest.approx(want)


def test_counts_of_larger_classes():
    counts = tails.u_counts(8, 400)
    assert sum(counts) == comb(408, 8) and counts == counts[::-1]
    # classes at the limit: exact and asymptotic forms meet
    exact = tails.ks_exact_p(0.03, 4000, 3500)
    en = (4000 * 3500 / 7500) ** 0.5
    assert exact == pytest.approx(tails.kolmogorov_sf((en + 0.12 + 0.11 / en) * 0.03), rel=0.03)
    assert 0 < tails.ks_exact_p(0.9, 300, 250) < 1e-80
    assert tails.ks_exact_p(1.0, 40, 3) == pytest.approx(2 / comb(43, 3))


def test_records_use_the_exact_forms(spark):
    rng = np.random.default_rng(1)
    rows = [(float(v), int(k >= 12)) for k, v in enumerate(rng.permutation(17))] + [(None, 1), (1.5, None)]
    df = spark.createDataFrame(rows, "x double, TARGET int")
    x0 = [v for v, y in rows if y == 0]
    x1 = [v for v, y in rows if y == 1 and v is not None]
    u = sum(a > b for a in x0 for b in x1)
    d = max(abs(sum(a <= v for a in x0) * len(x1) - sum(b <= v for b in x1) * len(x0)) for v in x0 + x1)
    every = list(orders(len(x0), len(x1)))
    top = max(u, len(x0) * len(x1) - u)
    mwu = hyp.mann_whitney_test(df, "x").first()
    ks = hyp.ks_test(df, "x").first()
    assert mwu.p_valor == pytest.approx(min(1, 2 * sum(v >= top for v, _ in every) / len(every)), abs=1e-6)
    assert ks.p_valor == pytest.approx(sum(e >= d for _, e in every) / len(every), abs=1e-6)
