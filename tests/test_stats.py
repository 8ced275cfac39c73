"""Ordered counts (J8), profiles, association, tests: hand-computed cases and
brute-force checks on small frames at several partition counts."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendspark.functions import tails
from lendspark.operators import assoc, evaluate as ev, hypothesis as hyp, profile as prof
from lendspark.operators.ordered import class_separation, exact_quantiles, hashed_row_numbers


def brute(values0, values1):
    u0 = sum((a > b) + 0.5 * (a == b) for a in values0 for b in values1)
    grid = sorted(set(values0) | set(values1))
    ks = max(abs(sum(v <= g for v in values0) / len(values0) - sum(v <= g for v in values1) / len(values1))
             for g in grid)
    return u0, 1 - u0 / (len(values0) * len(values1)), ks


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_class_separation_matches_brute_force(spark, parts):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, 300).tolist()       # heavy ties
    y = rng.integers(0, 2, 300).tolist()
    df = spark.createDataFrame(list(zip(x, y)), "x long, y int").repartition(parts)
    r = class_separation(df, "x", "y", n_buckets=5).first()
    x0 = [a for a, b in zip(x, y) if b == 0]
    x1 = [a for a, b in zip(x, y) if b == 1]
    u0, auc, ks = brute(x0, x1)
    assert r.u0 == pytest.approx(u0) and r.auc == pytest.approx(auc) and r.ks == pytest.approx(ks)


def test_all_equal_scores(spark):
    df = spark.createDataFrame([(0.3, i % 2) for i in range(20)], "s double, y int")
    r = class_separation(df, "s", "y").first()
    assert r.auc == pytest.approx(0.5) and r.ks == pytest.approx(0.0)


def test_auc_of_reversed_score(spark):
    rng = np.random.default_rng(3)
    rows = [(float(v), int(t)) for v, t in zip(rng.random(200), rng.integers(0, 2, 200))]
    df = spark.createDataFrame(rows, "s double, y int")
    a = ev.evaluate(df, "y", "s").first().auc_roc
    b = ev.evaluate(df.withColumn("s", 1 - F.col("s")), "y", "s").first().auc_roc
    assert a + b == pytest.approx(1.0)


@pytest.mark.parametrize("parts", [1, 3])
def test_exact_quantiles(spark, parts):
    vals = [1, 3, 9, 10, 10, 2, 7]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(parts)
    q = exact_quantiles(df, "v", [0.25, 0.5, 0.9], names=["a", "b", "c"]).first()
    assert (q.a, q.b, q.c) == pytest.approx(tuple(np.quantile(vals, [0.25, 0.5, 0.9])))
    # Spark's approximate imputer median on {1,3,9,10} gives 3; exact is 6
    df2 = spark.createDataFrame([(1.0,), (3.0,), (9.0,), (10.0,)], "v double")
    assert exact_quantiles(df2, "v", [0.5], names=["m"]).first().m == 6.0


def test_hashed_row_numbers_are_dense(spark):
    df = spark.range(1000).withColumn("g", (F.col("id") % 3).cast("int"))
    out = hashed_row_numbers(df, ["g"], F.xxhash64("id", F.lit(42)))
    per = out.groupBy("g").agg(F.min("_rn").alias("mn"), F.max("_rn").alias("mx"),
                               F.count("*").alias("n"), F.countDistinct("_rn").alias("d")).collect()
    for r in per:
        assert r.mn == 0 and r.mx == r.n - 1 and r.d == r.n


def test_sample_skew_kurt(spark):
    df = spark.createDataFrame([(float(v), 0) for v in [1, 4, 9, 16, 25]], "x double, TARGET int")
    r = prof.numeric_profile(df).first()
    assert r.skewness == pytest.approx(0.6996, abs=1e-4)
    assert r.kurtosis == pytest.approx(-0.6423, abs=1e-4)
    assert r.mediana == 9.0 and r.n_unicos == 5 and r.pct_nulos == 0.0


def test_default_rate_min_group(spark):
    rows = [("a", 1 if i < 3 else 0) for i in range(29)] + [("b", 1 if i < 6 else 0) for i in range(30)] \
        + [(None, 1)] * 40
    df = spark.createDataFrame(rows, "cat string, TARGET int")
    out = prof.default_rate_by_group(df, "cat").collect()
    assert [r.categoria for r in out] == ["b"]
    assert out[0].taxa_inadimplencia_pct == 20.0
    overall = (3 + 6 + 40) / 99 * 100
    assert out[0].diferenca_media_pct == round(20.0 - overall, 2)
    with pytest.raises(KeyError):
        prof.default_rate_by_group(df, "nope")


def test_chi2_with_and_without_yates(spark):
    rows = [("x", 0)] * 10 + [("x", 1)] * 3 + [("y", 0)] * 4 + [("y", 1)] * 9
    df = spark.createDataFrame(rows, "c string, TARGET int")
    with_y = assoc.chi2_by_column(df, ["c"]).first()
    without = assoc.chi2_by_column(df, ["c"], correction=False).first()
    assert with_y.chi2 == pytest.approx(3.8690, abs=1e-4)
    assert without.chi2 == pytest.approx(5.5714, abs=1e-4)
    rec = hyp.chi2_test(df, "c").first()
    assert rec.estatistica == pytest.approx(3.869, abs=1e-4)
    assert rec.p_valor == pytest.approx(tails.chi2_sf(3.8690, 1), abs=1e-5)
    assert rec.rejeita_h0 == (tails.chi2_sf(with_y.chi2, 1) < 0.05)


def test_p_values_against_known_constants():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert tails.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, rel=1e-9)
    assert tails.t_two_sided_p(2.0, 10) == pytest.approx(0.07338803477074596, rel=1e-8)
    assert tails.normal_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-9)
    assert tails.kolmogorov_sf(1.3580986393225507) == pytest.approx(0.05, abs=1e-6)


def test_mann_whitney_p_formula():
    # two groups with ties: U0 = 3.5, n0 = n1 = 3, tie term from one pair of ties
    u0, n0, n1, ties = 3.5, 3, 3, 6.0
    mu = 4.5
    sigma = math.sqrt(n0 * n1 / 12 * ((7) - ties / (6 * 5)))
    z = (max(u0, 9 - u0) - mu - 0.5) / sigma
    assert tails.mann_whitney_p(u0, n0, n1, ties) == pytest.approx(min(1.0, 2 * tails.normal_sf(z)))


def test_battery_one_job_per_kind(spark, df_with_target):
    bat = hyp.test_battery(df_with_target).collect()
    kinds = {r.teste for r in bat}
    assert kinds == {"Mann-Whitney U", "Qui-Quadrado"}
    ps = [r.p_valor for r in bat]
    assert ps == sorted(ps)
    assert {r.variavel for r in bat if r.teste == "Qui-Quadrado"} == {"CODE_GENDER", "NAME_INCOME_TYPE"}


def test_spearman_and_kendall_brute(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 8, 60).astype(float).tolist()
    y = rng.integers(0, 2, 60).tolist()
    df = spark.createDataFrame(list(zip(x, y)), "x double, TARGET int")
    sp = assoc.correlation_with_target(df, "spearman").first().correlacao
    kd = assoc.correlation_with_target(df, "kendall").first().correlacao

    def ranks(v):
        order = sorted(range(len(v)), key=lambda i: v[i])
        r = [0.0] * len(v)
        i = 0
        while i < len(v):
            j = i
            while j + 1 < len(v) and v[order[j + 1]] == v[order[i]]:
                j += 1
            for k in range(i, j + 1):
                r[order[k]] = (i + j) / 2 + 1
            i = j + 1
        return r
    assert sp == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    conc = disc = tx = ty = 0
    for i, j in itertools.combinations(range(60), 2):
        dx, dy = x[i] - x[j], y[i] - y[j]
        if dx == 0 and dy == 0:
            continue
        if dx == 0:
            tx += 1
        elif dy == 0:
            ty += 1
        elif dx * dy > 0:
            conc += 1
        else:
            disc += 1
    tau_b = (conc - disc) / math.sqrt((conc + disc + tx) * (conc + disc + ty))
    assert kd == pytest.approx(tau_b)


def test_evaluate_metrics(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.2, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    m = ev.evaluate(df).first()
    assert m.auc_roc == pytest.approx(8 / 9)
    assert m.gini == pytest.approx(2 * 8 / 9 - 1)
    assert m.precision == pytest.approx(3 / 4) and m.recall == pytest.approx(1.0)
    ll = -np.mean([math.log(0.9), math.log(0.8), math.log(0.3), math.log(0.6), math.log(0.8), math.log(0.9)])
    assert m.log_loss == pytest.approx(ll)
    pts = ev.roc_points(df).collect()
    assert len(pts) == 7 and sum(p.is_ks_point for p in pts) == 1


def test_distinct_counts_exact_and_approx(spark):
    df = spark.createDataFrame([(i % 7, None if i % 5 == 0 else f"s{i % 3}") for i in range(100)],
                               "a int, b string")
    ex = {r.coluna: r.n_unicos for r in prof.distinct_counts(df).collect()}
    ap = {r.coluna: r.n_unicos for r in prof.distinct_counts(df, exact=False).collect()}
    assert ex == {"a": 7, "b": 3} and ap == ex


def test_chart_data(spark):
    from lendspark.operators import charts
    rng = np.random.default_rng(5)
    rows = [(float(v), int(t)) for v, t in zip(rng.normal(10, 2, 400), rng.integers(0, 2, 400))]
    df = spark.createDataFrame(rows, "x double, TARGET int")
    dens = charts.density_by_class(df, "x", trim_percentile=None, grid=400).toPandas()
    for t, g in dens.groupby("TARGET"):
        area = np.trapezoid(g.density, g.x)
        assert 0.9 < area <= 1.01          # mass inside [min, max] of the data
    h = charts.histogram(df, "x", bins=10).collect()
    assert sum(r["count"] for r in h) == 400 and max(r.bin for r in h) == 10
    counts, _ = np.histogram([r[0] for r in rows], bins=10)
    assert [r["count"] for r in sorted(h, key=lambda r: r.bin)] == [c for c in counts if c > 0]
    box = charts.box_stats(df, "x").collect()
    x0 = np.array([v for v, t in rows if t == 0])
    q1, q3 = np.quantile(x0, [0.25, 0.75])
    b0 = [b for b in box if b.TARGET == 0][0]
    assert b0.q1 == pytest.approx(q1) and b0.q3 == pytest.approx(q3)
    assert b0.whisker_low == pytest.approx(x0[x0 >= q1 - 1.5 * (q3 - q1)].min())
    bal = charts.class_balance(df).collect()
    assert sum(r.pct for r in bal) == pytest.approx(100.0)


def test_battery_skips_two_valued_numeric(spark):
    rows = [(float(i % 2), float(i), i % 3 == 0 and 1 or 0) for i in range(60)]
    df = spark.createDataFrame(rows, "flag double, x double, TARGET int")
    names = {r.variavel for r in hyp.test_battery(df).collect()}
    assert names == {"x"}


@pytest.mark.parametrize("buckets", [1, 2, 7])
def test_grouped_quantiles_with_hot_value_match_numpy(spark, buckets):
    rng = np.random.default_rng(7)
    rows = []
    for g in ("a", "b", "c"):
        vals = [float(x) for x in rng.integers(0, 50, 200)]
        vals += [13.0] * 100                      # one value holds a third of the group
        rows += [(g, v) for v in vals]
    rows += [("d", 5.0)]                          # single-row group
    df = spark.createDataFrame(rows + [("a", None)], "g string, v double").repartition(3)
    from lendspark.operators.ordered import quantile_parts
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, "v", probs, groups=["g"], n_buckets=buckets,
                                              names=["p0", "p10", "p50", "p75", "p100"]).collect()}
    parts = {r["g"]: r for r in quantile_parts(df, "v", [0.5], groups=["g"], n_buckets=buckets).collect()}
    for g in ("a", "b", "c", "d"):
        vals = np.array([v for gg, v in rows if gg == g])
        want = np.percentile(vals, [p * 100 for p in probs])
        assert [got[g][n] for n in ("p0", "p10", "p50", "p75", "p100")] == pytest.approx(list(want))
        assert parts[g]["_N"] == len(vals)
        assert parts[g]["_D"] == len(set(vals.tolist()))
