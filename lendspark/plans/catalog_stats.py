"""Registered association, hypothesis-test and evaluation queries.

The SQL gets tail probabilities, for which DuckDB has no functions, by Simpson's rule
over the density's upper tail; exact KS p-values by walking all lattice paths diagonal
by diagonal, exact p-values of small classes by listing all orders.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lendspark.operators import assoc, evaluate as ev, hypothesis as hyp
from lendspark.operators.profile import numeric_columns
from lendspark.plans.catalog import (ENRICHED_WITH, enriched, r4, r6, register)
from lendspark.sources import roles
from lendspark.sources.roles import APPLICATION_SQL, SCORES_SQL, with_sql

ENRICHED_NUMERIC = ["SK_ID_CURR", "AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "DAYS_BIRTH",
                    "DAYS_EMPLOYED", "CNT_FAM_MEMBERS", "bureau_loan_count", "bureau_active_loans",
                    "bureau_total_credit_sum", "bureau_mean_days_credit", "cc_utilization_mean",
                    "cc_drawings_total", "cc_months_with_balance", "install_payment_ratio_mean",
                    "install_days_late_mean", "install_late_count"]
CATEGORICAL = ["NAME_CONTRACT_TYPE", "NAME_INCOME_TYPE", "ORGANIZATION_TYPE"]


def _long_sql(table: str, cols, label: str = "TARGET") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS cname, CAST({c} AS DOUBLE) AS value, {label} AS y FROM {table} "
        f"WHERE {c} IS NOT NULL AND {label} IS NOT NULL" for c in cols)


# ---------------------------------------------------------------------------
# F1-F4 correlations
# ---------------------------------------------------------------------------

@register("correlation_pearson", ENRICHED_WITH + ", c AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS coluna, corr({c}, TARGET) AS r FROM enriched" for c in ENRICHED_NUMERIC) + """)
SELECT coluna, round_even(r, 6) AS correlacao FROM c WHERE r IS NOT NULL AND NOT isnan(r)
ORDER BY correlacao, coluna""")
def q_correlation_pearson(spark, sf_dir):
    e = enriched(spark, sf_dir)  # one aggregate pass: nothing to materialize
    assert sorted(numeric_columns(e, exclude=["TARGET"])) == sorted(ENRICHED_NUMERIC)
    c = assoc.correlation_with_target(e, "pearson")
    return c.select("coluna", r6("correlacao").alias("correlacao"))


@register("correlation_pearson_top3", ENRICHED_WITH + ", c AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS coluna, corr({c}, TARGET) AS r FROM enriched" for c in ENRICHED_NUMERIC) + """),
v AS (SELECT * FROM c WHERE r IS NOT NULL AND NOT isnan(r)),
lo AS (SELECT coluna, r FROM v ORDER BY r, coluna LIMIT 3),
hi AS (SELECT coluna, r FROM v ORDER BY r DESC, coluna DESC LIMIT 3)
SELECT coluna, round_even(r, 6) AS correlacao FROM lo
UNION ALL SELECT coluna, round_even(r, 6) AS correlacao FROM hi""")
def q_correlation_pearson_top3(spark, sf_dir):
    c = assoc.correlation_with_target(enriched(spark, sf_dir), "pearson", top_n=3)
    return c.select("coluna", r6("correlacao").alias("correlacao"))


_RANK_SQL = """
, lv AS ({long}),
rk AS (
  SELECT cname, y,
         rank() OVER (PARTITION BY cname ORDER BY value)
           + (count(*) OVER (PARTITION BY cname, value) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY cname ORDER BY y)
           + (count(*) OVER (PARTITION BY cname, y) - 1) / 2.0 AS ry
  FROM lv)
SELECT cname AS coluna, round_even(corr(rx, ry), 6) AS correlacao FROM rk
GROUP BY cname HAVING corr(rx, ry) IS NOT NULL AND NOT isnan(corr(rx, ry))"""


@register("correlation_spearman", ENRICHED_WITH + _RANK_SQL.format(long=_long_sql("enriched", ENRICHED_NUMERIC)))
def q_correlation_spearman(spark, sf_dir):
    c = assoc.correlation_with_target(enriched(spark, sf_dir, materialize=True), "spearman")
    return c.select("coluna", r6("correlacao").alias("correlacao"))


_KENDALL_SQL = """
, lv AS ({long}),
cnt AS (SELECT cname, value, count(*) FILTER (WHERE y = 0) AS c0,
               count(*) FILTER (WHERE y = 1) AS c1, count(*) AS n
        FROM lv GROUP BY cname, value),
cum AS (SELECT *, coalesce(sum(c0) OVER w, 0) AS b0, coalesce(sum(c1) OVER w, 0) AS b1 FROM cnt
        WINDOW w AS (PARTITION BY cname ORDER BY value
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
agg AS (SELECT cname, sum(c1 * b0 - c0 * b1) AS cd, sum(n * (n - 1) / 2.0) AS tx,
               sum(c0) AS n0, sum(c1) AS n1 FROM cum GROUP BY cname),
t AS (SELECT cname, cd / sqrt(((n0 + n1) * (n0 + n1 - 1) / 2.0 - tx) * n0 * n1) AS tau FROM agg)
SELECT cname AS coluna, round_even(tau, 6) AS correlacao FROM t
WHERE tau IS NOT NULL AND NOT isnan(tau)"""


@register("correlation_kendall", ENRICHED_WITH + _KENDALL_SQL.format(long=_long_sql("enriched", ENRICHED_NUMERIC)))
def q_correlation_kendall(spark, sf_dir):
    c = assoc.correlation_with_target(enriched(spark, sf_dir, materialize=True), "kendall")
    return c.select("coluna", r6("correlacao").alias("correlacao"))


_KENDALL_CLASS_SQL = """
WITH o AS (
  SELECT CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS y, o_totalprice, o_custkey, c_acctbal,
         date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS o_day
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
lv AS ({long}),
k AS (SELECT cname, value, y, count(*) AS k FROM lv GROUP BY ALL),
grid AS (
  SELECT v.cname, v.value, c.y, coalesce(k.k, 0) AS k
  FROM (SELECT DISTINCT cname, value FROM k) v JOIN (SELECT DISTINCT cname, y FROM k) c USING (cname)
  LEFT JOIN k ON k.cname = v.cname AND k.value = v.value AND k.y = c.y),
cum AS (
  SELECT *, coalesce(sum(k) OVER (PARTITION BY cname, y ORDER BY value
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM grid),
cd AS (
  SELECT cname, sum(k * (less - more)) AS cd FROM (
    SELECT cname, k,
           coalesce(sum(b) OVER (PARTITION BY cname, value ORDER BY y
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less,
           coalesce(sum(b) OVER (PARTITION BY cname, value ORDER BY y DESC
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS more FROM cum)
  GROUP BY cname),
tx AS (SELECT cname, sum(n * (n - 1) / 2.0) AS tx, sum(n) AS n FROM (
         SELECT cname, value, sum(k) AS n FROM k GROUP BY ALL) GROUP BY cname),
ty AS (SELECT cname, sum(n * (n - 1) / 2.0) AS ty FROM (
         SELECT cname, y, sum(k) AS n FROM k GROUP BY ALL) GROUP BY cname)
SELECT cname AS coluna, round_even(cd / sqrt((n * (n - 1) / 2.0 - tx) * (n * (n - 1) / 2.0 - ty)), 6) AS correlacao
FROM cd JOIN tx USING (cname) JOIN ty USING (cname)"""
_KENDALL_CLASS_COLS = ["o_totalprice", "o_custkey", "o_day", "c_acctbal"]


@register("correlation_kendall_five_classes", _KENDALL_CLASS_SQL.format(long=_long_sql("o", _KENDALL_CLASS_COLS, "y")))
def q_correlation_kendall_five_classes(spark, sf_dir):
    """F3 for a label of five ordered classes."""
    o = roles.table(spark, sf_dir, "orders").join(
        roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"),
        "o_custkey", "left")
    o = o.select(F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"), "o_totalprice", "o_custkey",
                 "c_acctbal", F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("o_day"))
    c = assoc.correlation_with_target(o, "kendall", target="priority", columns=_KENDALL_CLASS_COLS)
    return c.select("coluna", r6("correlacao").alias("correlacao"))


_MATRIX_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("correlation_matrix_lineitem", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round_even(corr({a}, {b}), 6) AS corr FROM lineitem"
    for i, a in enumerate(_MATRIX_COLS) for b in _MATRIX_COLS[:i]))
def q_correlation_matrix_lineitem(spark, sf_dir):
    m = assoc.correlation_matrix(roles.table(spark, sf_dir, "lineitem"), _MATRIX_COLS)
    return m.select("col_a", "col_b", r6("corr").alias("corr"))


@register("correlation_matrix_auto_orders", """
SELECT 'o_totalprice' AS col_a, 'o_custkey' AS col_b, round_even(corr(o_totalprice, o_custkey), 6) AS corr FROM orders
UNION ALL SELECT 'o_custkey', 'o_orderkey', round_even(corr(o_custkey, o_orderkey), 6) FROM orders
UNION ALL SELECT 'o_totalprice', 'o_orderkey', round_even(corr(o_totalprice, o_orderkey), 6) FROM orders""")
def q_correlation_matrix_auto_orders(spark, sf_dir):
    o = roles.table(spark, sf_dir, "orders")
    m = assoc.correlation_matrix(o)  # columns picked by null share (B8)
    return m.select("col_a", "col_b", r6("corr").alias("corr"))


def _simpson_sql(f: str, start: str, width: str, steps: int = 2000) -> str:
    """Integral of ``f`` (an expression in x) from ``start`` over ``width``."""
    at = re.sub(r"\bx\b", f"(({start}) + i * ({width}) / {steps}.0)", f)
    return (f"(list_sum([(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({at}) "
            f"FOR i IN range(0, {steps + 1})]) * ({width}) / {steps}.0 / 3)")


def _t_two_sided_sql(r: str, n: str) -> str:
    """p of a correlation r over n pairs: with t = sqrt(dof) tan(x)."""
    dof = f"({n} - 2)"
    start = f"atan(abs({r}) / sqrt(1 - {r} * {r}))"
    width = f"least(pi() / 2 - {start}, 14.0 / sqrt({dof}))"
    tail = _simpson_sql(f"exp(({dof} - 1) * ln(greatest(cos(x), 1e-300)))", start, width)
    return f"least(1.0, 2 * exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi()) * {tail})"


@register("point_biserial", ENRICHED_WITH + ", lv AS (" + _long_sql("enriched", ENRICHED_NUMERIC) + """),
c AS (SELECT cname, corr(value, y) AS r, count(*) AS n FROM lv GROUP BY cname HAVING count(DISTINCT value) > 2),
t AS (SELECT cname, r, """ + _t_two_sided_sql("r", "n") + """ AS p FROM c)
SELECT cname AS coluna, round_even(r, 6) AS correlacao, round_even(p, 6) AS p_valor, p < 0.05 AS significativo
FROM t""")
def q_point_biserial(spark, sf_dir):
    pb = assoc.point_biserial(enriched(spark, sf_dir, materialize=True))
    return pb.select("coluna", r6("correlacao").alias("correlacao"),
                     r6("p_valor").alias("p_valor"), "significativo")


def _chi2_sql(table_with: str, table: str, cols, label: str = "TARGET") -> str:
    long = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS cname, CAST({c} AS VARCHAR) AS value, {label} AS y FROM {table} "
        f"WHERE {c} IS NOT NULL AND {label} IS NOT NULL" for c in cols)
    return table_with + f"""
, lv AS ({long}),
cells AS (SELECT cname, value, y, count(*) AS obs FROM lv GROUP BY ALL),
rt AS (SELECT cname, value, sum(obs) AS rt FROM cells GROUP BY ALL),
ct AS (SELECT cname, y, sum(obs) AS ct FROM cells GROUP BY ALL),
dims AS (SELECT cname, sum(obs) AS n, count(DISTINCT value) AS r, count(DISTINCT y) AS c
         FROM cells GROUP BY cname),
full_t AS (
  SELECT rt.cname, rt.rt * ct.ct * 1.0 / dims.n AS e, coalesce(cells.obs, 0) * 1.0 AS o,
         (dims.r - 1) * (dims.c - 1) AS dof, dims.n, least(dims.r, dims.c) - 1 AS k
  FROM rt JOIN ct USING (cname) JOIN dims USING (cname)
  LEFT JOIN cells ON cells.cname = rt.cname AND cells.value = rt.value AND cells.y = ct.y),
adj AS (
  SELECT *, CASE WHEN dof = 1 THEN o + sign(e - o) * least(0.5, abs(e - o)) ELSE o END AS a FROM full_t)
"""


@register("cramers_v_application", _chi2_sql(with_sql(APPLICATION_SQL), "application", CATEGORICAL) + """
, chi AS (SELECT cname, CASE WHEN max(dof) = 0 THEN 0.0 ELSE sum((a - e) * (a - e) / e) END AS chi2,
                 max(n) AS n, max(k) AS k FROM adj GROUP BY cname)
SELECT cname AS coluna,
       round_even(CASE WHEN k > 0 THEN sqrt(chi2 / (n * k)) ELSE 0.0 END, 4) AS cramer_v
FROM chi ORDER BY cramer_v, coluna""")
def q_cramers_v_application(spark, sf_dir):
    return assoc.cramers_v(roles.application(spark, sf_dir), columns=CATEGORICAL)


@register("cramers_v_toxic_vs_quality", _chi2_sql("WITH l AS (SELECT * FROM labels)", "l", ["toxic"], "quality") + """
, chi AS (SELECT cname, CASE WHEN max(dof) = 0 THEN 0.0 ELSE sum((a - e) * (a - e) / e) END AS chi2,
                 max(n) AS n, max(k) AS k FROM adj GROUP BY cname)
SELECT cname AS coluna,
       round_even(CASE WHEN k > 0 THEN sqrt(chi2 / (n * k)) ELSE 0.0 END, 4) AS cramer_v FROM chi""")
def q_cramers_v_toxic_vs_quality(spark, sf_dir):
    return assoc.cramers_v(roles.table(spark, sf_dir, "labels"), target="quality", columns=["toxic"])


# ---------------------------------------------------------------------------
# G1-G4 statistics (oracle) and full records (rows-only)
# ---------------------------------------------------------------------------

@register("chi2_statistic_application", _chi2_sql(with_sql(APPLICATION_SQL), "application", CATEGORICAL) + """
SELECT cname AS variavel,
       round_even(CASE WHEN max(dof) = 0 THEN 0.0 ELSE sum((a - e) * (a - e) / e) END, 4) AS estatistica,
       CAST(max(dof) AS BIGINT) AS dof
FROM adj GROUP BY cname""")
def q_chi2_statistic_application(spark, sf_dir):
    chi = assoc.chi2_by_column(roles.application(spark, sf_dir), CATEGORICAL)
    return chi.select(F.col("coluna").alias("variavel"), r4("chi2").alias("estatistica"),
                      F.col("dof").cast("long").alias("dof"))


@register("chi2_statistic_yates_labels", _chi2_sql("WITH l AS (SELECT * FROM labels)", "l", ["toxic"], "quality") + """
SELECT cname AS variavel,
       round_even(CASE WHEN max(dof) = 0 THEN 0.0 ELSE sum((a - e) * (a - e) / e) END, 4) AS estatistica,
       CAST(max(dof) AS BIGINT) AS dof
FROM adj GROUP BY cname""")
def q_chi2_statistic_yates_labels(spark, sf_dir):
    chi = assoc.chi2_by_column(roles.table(spark, sf_dir, "labels"), ["toxic"], target="quality")
    return chi.select(F.col("coluna").alias("variavel"), r4("chi2").alias("estatistica"),
                      F.col("dof").cast("long").alias("dof"))


_MWU_COLS = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "DAYS_BIRTH", "bureau_total_credit_sum",
             "install_days_late_mean"]

_SEP_SQL = """
, lv AS ({long}),
rk AS (SELECT cname, value, y,
              rank() OVER (PARTITION BY cname ORDER BY value)
                + (count(*) OVER (PARTITION BY cname, value) - 1) / 2.0 AS r
       FROM lv),
u AS (SELECT cname, sum(r) FILTER (WHERE y = 0) AS r0, count(*) FILTER (WHERE y = 0) AS n0,
             count(*) FILTER (WHERE y = 1) AS n1 FROM rk GROUP BY cname),
cnt AS (SELECT cname, value, count(*) FILTER (WHERE y = 0) AS c0, count(*) FILTER (WHERE y = 1) AS c1
        FROM lv GROUP BY cname, value),
cum AS (SELECT cname, sum(c0) OVER w AS a0, sum(c1) OVER w AS a1 FROM cnt
        WINDOW w AS (PARTITION BY cname ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT cum.cname, max(abs(a1 * 1.0 / u.n1 - a0 * 1.0 / u.n0)) AS d
       FROM cum JOIN u USING (cname) GROUP BY cum.cname)"""


@register("mann_whitney_u", ENRICHED_WITH + _SEP_SQL.format(long=_long_sql("enriched", _MWU_COLS)) + """
SELECT cname AS variavel, round_even(r0 - n0 * (n0 + 1) / 2.0, 4) AS estatistica, n0, n1
FROM u WHERE n0 > 0 AND n1 > 0""")
def q_mann_whitney_u(spark, sf_dir):
    sep = hyp._separation(enriched(spark, sf_dir, materialize=True), _MWU_COLS, "TARGET")
    return sep.where((F.col("n0") > 0) & (F.col("n1") > 0)).select(
        F.col("column").alias("variavel"), r4("u0").alias("estatistica"), "n0", "n1")


@register("ks_two_sample_statistic", ENRICHED_WITH + _SEP_SQL.format(long=_long_sql("enriched", _MWU_COLS)) + """
SELECT cname AS variavel, round_even(d, 6) AS estatistica FROM ks""")
def q_ks_two_sample_statistic(spark, sf_dir):
    sep = hyp._separation(enriched(spark, sf_dir, materialize=True), _MWU_COLS, "TARGET")
    return sep.select(F.col("column").alias("variavel"), r6("ks").alias("estatistica"))


# -- p-values in SQL ----------------------------------------------------------

def _normal_sf_sql(z: str) -> str:
    return _simpson_sql("exp(-0.5 * x * x) / sqrt(2 * pi())", z, "10.0")


def _chi2_sf_sql(chi: str, dof: str) -> str:
    """With x = s^2, so that the density is smooth at one degree of freedom."""
    density = (f"exp((1 - {dof} / 2.0) * ln(2) - lgamma({dof} / 2.0) - x * x / 2 + "
               f"CASE WHEN {dof} = 1 THEN 0 ELSE ({dof} - 1) * ln(x) END)")
    tail = _simpson_sql(density, f"sqrt({chi})", f"(12.0 + sqrt({dof}))")
    return f"(CASE WHEN {dof} = 0 OR {chi} <= 0 THEN 1.0 ELSE least(1.0, {tail}) END)"


_MWU_P_SQL = """,
ties AS (SELECT cname, sum((c0 + c1) * (c0 + c1) * (c0 + c1) - (c0 + c1)) AS tie_term, count(*) AS n_distinct
         FROM cnt GROUP BY cname),
mwu_z AS (
  SELECT cname, n_distinct, r0 - n0 * (n0 + 1) / 2.0 AS u0, n0, n1,
         (greatest(r0 - n0 * (n0 + 1) / 2.0, n0 * n1 - (r0 - n0 * (n0 + 1) / 2.0)) - n0 * n1 / 2.0 - 0.5)
         / sqrt(n0 * n1 / 12.0 * ((n0 + n1 + 1) - tie_term * 1.0 / ((n0 + n1) * (n0 + n1 - 1)))) AS z
  FROM u JOIN ties USING (cname) WHERE n0 > 0 AND n1 > 0),
mwu AS (SELECT cname, n_distinct, u0, least(1.0, 2 * """ + _normal_sf_sql("z") + """) AS p FROM mwu_z)"""

_CHI2_P_SQL = """,
chi AS (SELECT cname, CASE WHEN max(dof) = 0 THEN 0.0 ELSE sum((a - e) * (a - e) / e) END AS chi2, max(dof) AS dof
        FROM adj GROUP BY cname),
chi_p AS (SELECT cname, chi2, """ + _chi2_sf_sql("chi2", "dof") + """ AS p FROM chi)"""

# exact for classes of up to 10,000 rows (the band of the diagonal s holds the i with
# |i (n0 + n1) - s n0| < lim), else Stephens' form
_KS_P_SQL = """,
ks_n AS (SELECT cname, d, n0, n1, n0 + n1 AS nn, CAST(round(d * n0 * n1) AS BIGINT) AS lim FROM ks JOIN u USING (cname)
         WHERE n0 > 0 AND n1 > 0),
walk(cname, n0, n1, nn, lim, s, lo, q, gone) AS (
  SELECT cname, n0, n1, nn, lim, CAST(0 AS BIGINT), CAST(0 AS BIGINT), [CAST(1 AS DOUBLE)], CAST(0 AS DOUBLE)
  FROM ks_n WHERE greatest(n0, n1) <= 10000 AND lim > 0
  UNION ALL
  SELECT cname, n0, n1, nn, lim, s + 1, new_lo,
         list_slice(v, new_lo - lo + 1, new_hi - lo + 1),
         gone + list_sum(v) - coalesce(list_sum(list_slice(v, new_lo - lo + 1, new_hi - lo + 1)), 0)
  FROM (
    SELECT *, [coalesce(q[i - lo + 1], 0) * (n1 - (s - i)) / (nn - s)
               + CASE WHEN i > lo THEN q[i - lo] * (n0 - i + 1) / (nn - s) ELSE 0 END
               FOR i IN range(lo, lo + len(q) + 1)] AS v,
           greatest(lo, CAST(floor(((s + 1) * n0 - lim) / nn) AS BIGINT) + 1) AS new_lo,
           least(lo + len(q), CAST(ceil(((s + 1) * n0 + lim) / nn) AS BIGINT) - 1) AS new_hi
    FROM walk WHERE s < nn)),
ks_exact AS (SELECT cname, max(gone) AS p FROM walk GROUP BY cname),
ks_p AS (
  SELECT cname, d, coalesce(p, least(1.0, greatest(0.0, 2 * list_sum([
           (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * lambda_ * lambda_) FOR j IN range(1, 100)])))) AS p
  FROM (SELECT *, (sqrt(n0 * n1 * 1.0 / nn) + 0.12 + 0.11 / sqrt(n0 * n1 * 1.0 / nn)) * d AS lambda_ FROM ks_n)
  LEFT JOIN ks_exact USING (cname))"""


def _tests_sql(numeric) -> str:
    """CTEs with the statistics and p-values of the enriched table."""
    sep = re.sub(r"\blv\b", "num", _SEP_SQL.format(long=_long_sql("enriched", numeric)))
    return (re.sub(r"^\s*WITH\b", "WITH RECURSIVE", _chi2_sql(ENRICHED_WITH, "enriched", CATEGORICAL).rstrip())
            + _CHI2_P_SQL + sep + _MWU_P_SQL)


_BATTERY_SQL = _tests_sql(ENRICHED_NUMERIC) + """,
battery AS (
  SELECT cname AS variavel, 'Mann-Whitney U' AS teste, round_even(u0, 4) AS estatistica,
         round_even(p, 6) AS p_valor, p < 0.05 AS rejeita_h0 FROM mwu WHERE n_distinct > 2
  UNION ALL
  SELECT cname, 'Qui-Quadrado', round_even(chi2, 4), round_even(p, 6), p < 0.05 FROM chi_p)
"""


@register("hypothesis_battery", _BATTERY_SQL + "SELECT * FROM battery")
def q_hypothesis_battery(spark, sf_dir):
    e = enriched(spark, sf_dir, materialize=True)
    return hyp.test_battery(e)


def _text_sql(yes: str, no: str, *values: str) -> str:
    """A conclusion text: its %s are the column, the values, p and alpha."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"                          # noqa: E731
    yes, no = (re.sub("%s([^%]*)$", lambda m: "0.05" + m.group(1), t) for t in (yes, no))
    return (f"CASE WHEN p < 0.05 THEN printf({quoted(yes)}, {', '.join(['cname', *values, 'p'])}) "
            f"ELSE printf({quoted(no)}, cname, p) END")


_RECORDS_SQL = _tests_sql(_MWU_COLS) + _KS_P_SQL + f""",
med AS (SELECT cname, median(value) FILTER (WHERE y = 0) AS m0, median(value) FILTER (WHERE y = 1) AS m1
        FROM num GROUP BY cname),
rec AS (
  SELECT '{hyp.TEST_MWU}' AS nome_teste, cname AS variavel, u0 AS stat, p,
         {_text_sql(hyp.MWU_YES, hyp.MWU_NO, 'round(m0, 2)', 'round(m1, 2)')} AS conclusao FROM mwu JOIN med USING (cname)
  UNION ALL
  SELECT '{hyp.TEST_KS}', cname, d, p, {_text_sql(hyp.KS_YES, hyp.KS_NO, 'd')} FROM ks_p
  UNION ALL
  SELECT '{hyp.TEST_CHI2}', cname, chi2, p, {_text_sql(hyp.CHI2_YES, hyp.CHI2_NO)} FROM chi_p),
shown AS (SELECT nome_teste, variavel, round_even(stat, 4) AS estatistica, round_even(p, 6) AS p_valor,
                 CAST(0.05 AS DOUBLE) AS alpha, p < 0.05 AS rejeita_h0, conclusao FROM rec)
SELECT *, printf('[%s] %s' || chr(10) || '  Estatística = %.4f | p-valor = %.4e' || chr(10) || '  %s (alpha=0.05) → %s',
                 nome_teste, variavel, estatistica, p_valor * (1 + 1e-12),
                 CASE WHEN rejeita_h0 THEN '{hyp.STATUS_REJECT}' ELSE '{hyp.STATUS_KEEP}' END, conclusao) AS texto
FROM shown"""


@register("hypothesis_records_rendered", _RECORDS_SQL)
def q_hypothesis_records_rendered(spark, sf_dir):
    e = enriched(spark, sf_dir, materialize=True)
    recs = (hyp.mann_whitney_tests(e, _MWU_COLS)
            .unionByName(hyp.ks_tests(e, _MWU_COLS))
            .unionByName(hyp.chi2_tests(e, CATEGORICAL)))
    return hyp.render(recs)


@register("significance_summary", _BATTERY_SQL + """
SELECT count(*) AS n_testes, count(*) FILTER (WHERE rejeita_h0) AS n_significativos,
       count(*) FILTER (WHERE NOT rejeita_h0) AS n_nao_significativos,
       count(*) FILTER (WHERE rejeita_h0) / count(*) AS pct_significativos FROM battery""")
def q_significance_summary(spark, sf_dir):
    return hyp.significance_summary(hyp.test_battery(enriched(spark, sf_dir, materialize=True)))


# Means per nation (25 rows), Asia against the rest: small classes without ties.
_NATION_COLS = ["mean_balance", "mean_price", "supplier_balance"]
_SMALL_SQL = """
WITH RECURSIVE t AS (
  SELECT n_nationkey, CAST(r_name = 'ASIA' AS INTEGER) AS y, mean_balance, mean_price, supplier_balance
  FROM nation JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN (SELECT c_nationkey AS n_nationkey, avg(c_acctbal) AS mean_balance FROM customer GROUP BY 1) USING (n_nationkey)
  LEFT JOIN (SELECT c_nationkey AS n_nationkey, avg(o_totalprice) AS mean_price
             FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) USING (n_nationkey)
  LEFT JOIN (SELECT s_nationkey AS n_nationkey, avg(s_acctbal) AS supplier_balance
             FROM supplier GROUP BY 1) USING (n_nationkey))
""" + _SEP_SQL.format(long=_long_sql("t", _NATION_COLS, "y")).lstrip() + """,
n AS (SELECT DISTINCT n0, n1 FROM u WHERE n0 > 0 AND n1 > 0),
walk(n0, n1, i, j, uu, dd) AS (
  SELECT n0, n1, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM n
  UNION ALL
  SELECT n0, n1, i + step, j + 1 - step, uu + step * j,
         greatest(dd, abs((i + step) * n1 - (j + 1 - step) * n0))
  FROM walk, (SELECT unnest([CAST(0 AS BIGINT), CAST(1 AS BIGINT)]) AS step)
  WHERE (step = 1 AND i < n0) OR (step = 0 AND j < n1)),
every AS (SELECT n0, n1, uu, dd, count(*) AS k FROM walk WHERE i = n0 AND j = n1 GROUP BY ALL),
stat AS (
  SELECT '""" + hyp.TEST_MWU + """' AS nome_teste, cname, n0, n1, r0 - n0 * (n0 + 1) / 2.0 AS stat
  FROM u WHERE n0 > 0 AND n1 > 0
  UNION ALL
  SELECT '""" + hyp.TEST_KS + """', cname, n0, n1, d FROM ks JOIN u USING (cname) WHERE n0 > 0 AND n1 > 0),
tests AS (
  SELECT nome_teste, cname, stat, CASE WHEN nome_teste = '""" + hyp.TEST_MWU + """'
           THEN least(1.0, 2.0 * coalesce(sum(k) FILTER (WHERE uu >= greatest(stat, n0 * n1 - stat)), 0) / sum(k))
           ELSE 1.0 * coalesce(sum(k) FILTER (WHERE dd >= round(stat * n0 * n1)), 0) / sum(k) END AS p
  FROM stat JOIN every USING (n0, n1) GROUP BY nome_teste, cname, stat)
SELECT nome_teste, cname AS variavel, round_even(stat, 4) AS estatistica, round_even(p, 6) AS p_valor,
       p < 0.05 AS rejeita_h0 FROM tests"""


@register("hypothesis_small_classes", _SMALL_SQL)
def q_hypothesis_small_classes(spark, sf_dir):
    """G2 / G3 where exact p-values apply: whole tables as means per nation."""
    t = lambda name: roles.table(spark, sf_dir, name)                       # noqa: E731
    customer = t("customer").withColumnRenamed("c_nationkey", "n_nationkey")
    per = (t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", (F.col("r_name") == "ASIA").cast("int").alias("TARGET"))
           .join(customer.groupBy("n_nationkey").agg(F.avg("c_acctbal").alias("mean_balance")), "n_nationkey", "left")
           .join(t("orders").join(customer, F.col("c_custkey") == F.col("o_custkey"))
                 .groupBy("n_nationkey").agg(F.avg("o_totalprice").alias("mean_price")), "n_nationkey", "left")
           .join(t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
               F.avg("s_acctbal").alias("supplier_balance")), "n_nationkey", "left"))
    records = hyp.mann_whitney_tests(per, _NATION_COLS).unionByName(hyp.ks_tests(per, _NATION_COLS))
    return records.select("nome_teste", "variavel", "estatistica", "p_valor", "rejeita_h0")


# ---------------------------------------------------------------------------
# K1-K4 evaluation on the deterministic score
# ---------------------------------------------------------------------------

_EVAL_SQL = """
, rk AS (SELECT {g} TARGET AS y, score,
           rank() OVER (PARTITION BY {g} 1 ORDER BY score)
             + (count(*) OVER (PARTITION BY {g} score) - 1) / 2.0 AS r
         FROM scores WHERE TARGET IS NOT NULL AND score IS NOT NULL),
u AS (SELECT {g} sum(r) FILTER (WHERE y = 1) AS r1, count(*) FILTER (WHERE y = 0) AS n0,
             count(*) FILTER (WHERE y = 1) AS n1 FROM rk GROUP BY ALL),
cnt AS (SELECT {g} score, count(*) FILTER (WHERE y = 0) AS c0, count(*) FILTER (WHERE y = 1) AS c1
        FROM rk GROUP BY ALL),
cum AS (SELECT {g} sum(c0) OVER w AS a0, sum(c1) OVER w AS a1 FROM cnt
        WINDOW w AS (PARTITION BY {g} 1 ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT {gs} max(abs(a1 * 1.0 / n1 - a0 * 1.0 / n0)) AS ks FROM cum {join_u} {group}),
conf AS (SELECT {g}
           sum(CASE WHEN score >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp,
           sum(CASE WHEN score >= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS fp,
           sum(CASE WHEN score < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS fn,
           avg(-(y * ln(least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
                 + (1 - y) * ln(1 - least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))) AS log_loss
         FROM rk GROUP BY ALL),
m AS (SELECT {gs} (r1 - n1 * (n1 + 1) / 2.0) / (n0 * n1) AS auc, ks,
        CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END AS precision,
        CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END AS recall,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1, log_loss
      FROM u {join_ks} {join_conf})
"""


def _eval_sql(group: str | None) -> str:
    if group:
        g = f"{group},"
        return _EVAL_SQL.format(g=g, gs=f"cum.{group},", join_u=f"JOIN u USING ({group})",
                                group=f"GROUP BY cum.{group}",
                                join_ks=f"JOIN ks USING ({group})", join_conf=f"JOIN conf USING ({group})").replace(
            f"SELECT cum.{group}, (r1", f"SELECT {group}, (r1")
    return _EVAL_SQL.format(g="", gs="", join_u=", u", group="", join_ks=", ks", join_conf=", conf")


_EVAL_COLS = """round_even(auc, 6) AS auc_roc, round_even(2 * auc - 1, 6) AS gini, round_even(ks, 6) AS ks_stat,
       round_even(f1, 6) AS f1, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall,
       round_even(log_loss, 6) AS log_loss"""


def _eval_select(df):
    return [r6(c).alias(c) for c in ev.METRICS]


@register("evaluate_scores", with_sql(SCORES_SQL) + _eval_sql(None).lstrip().replace("\n, rk AS", ", rk AS", 1)
          + f"SELECT {_EVAL_COLS} FROM m")
def q_evaluate_scores(spark, sf_dir):
    m = ev.evaluate(roles.scores(spark, sf_dir), label="TARGET", score="score")
    return m.select(*_eval_select(m))


@register("compare_models_by_segment", with_sql(SCORES_SQL) + _eval_sql("segment")
          + f"SELECT segment AS model, {_EVAL_COLS} FROM m")
def q_compare_models_by_segment(spark, sf_dir):
    s = roles.scores(spark, sf_dir).withColumnRenamed("segment", "model")
    m = ev.compare_models(s, "model", label="TARGET", score="score")
    return m.select("model", *_eval_select(m))


@register("fold_metric_aggregation", with_sql(SCORES_SQL) + _eval_sql("segment") + """
SELECT round_even(avg(auc), 6) AS auc_roc_mean, round_even(stddev_pop(auc), 6) AS auc_roc_std,
       round_even(avg(ks), 6) AS ks_stat_mean, round_even(stddev_pop(ks), 6) AS ks_stat_std,
       round_even(avg(log_loss), 6) AS log_loss_mean, round_even(stddev_pop(log_loss), 6) AS log_loss_std,
       count(*) AS n_folds FROM m""")
def q_fold_metric_aggregation(spark, sf_dir):
    per = ev.evaluate(roles.scores(spark, sf_dir), label="TARGET", score="score", groups=["segment"])
    agg = ev.aggregate_folds(per, metrics=["auc_roc", "ks_stat", "log_loss"])
    return agg.select(*[r6(c).alias(c) for c in
                        ["auc_roc_mean", "auc_roc_std", "ks_stat_mean", "ks_stat_std",
                         "log_loss_mean", "log_loss_std"]], "n_folds")


@register("roc_points", with_sql(SCORES_SQL) + """
, cnt AS (SELECT score, count(*) FILTER (WHERE TARGET = 0) AS c0, count(*) FILTER (WHERE TARGET = 1) AS c1
          FROM scores WHERE TARGET IS NOT NULL AND score IS NOT NULL GROUP BY score),
tot AS (SELECT sum(c0) AS t0, sum(c1) AS t1 FROM cnt),
pts AS (SELECT score AS threshold,
               (t0 - coalesce(sum(c0) OVER w, 0)) / t0 AS fpr,
               (t1 - coalesce(sum(c1) OVER w, 0)) / t1 AS tpr
        FROM cnt, tot WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0),
best AS (SELECT threshold AS bt FROM pts ORDER BY abs(tpr - fpr) DESC, threshold DESC LIMIT 1)
SELECT threshold, round_even(fpr, 6) AS fpr, round_even(tpr, 6) AS tpr, threshold = bt AS is_ks_point
FROM pts, best""")
def q_roc_points(spark, sf_dir):
    r = ev.roc_points(roles.scores(spark, sf_dir), label="TARGET", score="score")
    return r.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"), "is_ks_point")
