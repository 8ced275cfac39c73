"""Level-by-level splitters, distributed inversion counts and the one-scan Gram matrix,
against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendspark.operators import assoc, concordance as C, gram as G, ordered as O


@pytest.mark.parametrize("fan,sample_from", [(3, 10 ** 9), (4, 50)])
def test_splitters_of_several_levels(spark, monkeypatch, fan, sample_from):
    """Blocks of blocks, with splitters from all values and from a sample."""
    monkeypatch.setattr(O, "FAN", fan)
    monkeypatch.setattr(O, "SAMPLE_FROM", sample_from)
    monkeypatch.setattr(O, "SAMPLE_ONE_IN", 3)
    monkeypatch.setattr(O, "SMALL_TABLE", 3)
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in "ab" for v in np.round(rng.exponential(10, 400), 1)] + [("c", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {(r.g, r.value): (r.n, r.before_n, r.total_n)
           for r in O.ordered_counts(df, "v", groups=["g"], n_buckets=30).collect()}
    want = {}
    for g in "abc":
        vals = [v for h, v in rows if h == g and v is not None]
        for v, n in Counter(vals).items():
            want[g, v] = (n, sum(x < v for x in vals), len(vals))
    assert got == want
    spread = O.with_buckets(O.collapse(df, "v", groups=["g"]), "value", ["g"], 30)
    sizes = {r.g: r.b for r in spread.groupBy("g").agg(F.count_distinct("_b").alias("b")).collect()}
    assert sizes["a"] > fan and sizes["c"] == 1
    q = {r.g: r.m for r in O.exact_quantiles(df, "v", [0.5], groups=["g"], names=["m"], n_buckets=30).collect()}
    assert all(q[g] == pytest.approx(np.median([v for h, v in rows if h == g and v is not None])) for g in "abc")


def tau(x, y):
    con = sum((a - b) * (c - d) > 0 for i, (a, c) in enumerate(zip(x, y)) for b, d in zip(x[:i], y[:i]))
    dis = sum((a - b) * (c - d) < 0 for i, (a, c) in enumerate(zip(x, y)) for b, d in zip(x[:i], y[:i]))
    n = len(x) * (len(x) - 1) / 2
    tie = lambda v: sum(k * (k - 1) / 2 for k in Counter(v).values())          # noqa: E731
    scale = math.sqrt((n - tie(x)) * (n - tie(y)))
    return (con - dis) / scale if scale else None


def test_concordance_in_one_block():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(0, 40))
        x, y, k = rng.integers(0, 8, n), rng.integers(0, 9, n), rng.integers(1, 5, n)
        con = sum(k[i] * k[j] for i in range(n) for j in range(i) if (x[i] - x[j]) * (y[i] - y[j]) > 0)
        dis = sum(k[i] * k[j] for i in range(n) for j in range(i) if (x[i] - x[j]) * (y[i] - y[j]) < 0)
        assert C.concordance(x, y, k) == (con, dis)


@pytest.mark.parametrize("block", [None, 25])
def test_kendall_of_any_label(spark, block):
    rng = np.random.default_rng(3)
    n = 300
    y = rng.integers(0, 5, n)
    data = {"hot": np.where(rng.random(n) < 0.4, 3, rng.integers(0, 50, n)), "smooth": rng.normal(size=n) + y,
            "flat": np.ones(n), "few": rng.integers(0, 3, n)}
    rows = [(float(y[i]), *[float(v[i]) for v in data.values()]) for i in range(n)] + [(None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "TARGET double, hot double, smooth double, flat double, few double").repartition(4)
    long = assoc.long_values(df.where("TARGET IS NOT NULL"), list(data), keep=["TARGET"])
    points = long.groupBy("column", F.col("value").alias("x"), F.col("TARGET").alias("y")).agg(F.count(F.lit(1)).alias("k"))
    got = {r.column: (r.tau, r.n) for r in C.tau_b(points, block).collect()}
    for c, v in data.items():
        want = tau(v.tolist(), y.tolist())
        assert got[c][1] == n and (got[c][0] is None if want is None else got[c][0] == pytest.approx(want))
    public = {r.coluna: r.correlacao for r in assoc.correlation_with_target(df, "kendall").collect()}
    assert set(public) == {"hot", "smooth", "few"} and public["few"] == pytest.approx(got["few"][0])


def test_gram_matrix_with_nulls_in_every_column(spark):
    rng = np.random.default_rng(4)
    n, k = 500, 11
    v = rng.normal(size=(n, k)) * 10.0 ** rng.integers(-3, 6, k) + 1e4 * rng.random(k)
    v[:, 5] = v[:, 2] * 2 + rng.normal(size=n)
    v[:, 7] = 4.2
    v[rng.random((n, k)) < 0.3] = np.nan
    v[:, 9] = np.nan
    v[3:, 10] = np.nan
    rows = [tuple(None if np.isnan(x) and i % 2 else float(x) for x in r) for i, r in enumerate(v)]
    names = [f"c.{i}" for i in range(k)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(5)
    got = {(r.col_a, r.col_b): r.corr for r in assoc.correlation_matrix(df, names).collect()}
    assert len(got) == k * (k - 1) // 2
    for i in range(k):
        for j in range(i):
            ok = ~np.isnan(v[:, i]) & ~np.isnan(v[:, j])
            a, b = v[ok, i], v[ok, j]
            if ok.sum() < 2 or np.ptp(a) == 0 or np.ptp(b) == 0:
                assert got[names[i], names[j]] is None
            else:
                assert got[names[i], names[j]] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-7)
    auto = {c for r in assoc.correlation_matrix(df).collect() for c in (r.col_a, r.col_b)}
    assert auto == set(names) - {names[9], names[10]}


def test_gram_of_many_columns_is_one_scan(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 130))
    names = [f"x{i}" for i in range(130)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in v], ", ".join(f"{c} double" for c in names)).repartition(3)
    m = G.pair_moments(df, names)
    assert m._jdf.queryExecution().executedPlan().toString().count("Scan") <= 1
    got = {(r.col_a, r.col_b): r.corr for r in G.pair_correlations(df, names).collect()}
    want = np.corrcoef(v.T)
    assert len(got) == 130 * 129 // 2
    assert all(got[names[i], names[j]] == pytest.approx(want[i, j]) for i, j in [(1, 0), (64, 63), (129, 0), (128, 65)])
    empty = G.pair_correlations(df.limit(0), names[:2]).collect()
    assert [r.corr for r in empty] in ([], [None])
