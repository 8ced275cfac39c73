"""Label-vs-variable hypothesis tests.

Statistics come from distributed jobs (contingency counts for chi-square,
ordered counts for Mann-Whitney U and two-sample KS); p-values from the
per-column scalars through an Arrow-batched pandas UDF. The battery tests all
columns in one job per test kind, not one job per column.

Result record (7 fields): ``nome_teste, variavel, estatistica, p_valor, alpha,
rejeita_h0, conclusao``. The decision uses the unrounded p; the statistic is
rounded to 4 and p to 6 afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lendspark.functions import tails
from lendspark.functions.nulls import round_half_even
from lendspark.operators.assoc import _chi2_p, chi2_by_column, scalar_udf
from lendspark.operators.ordered import class_separation, exact_quantiles
from lendspark.operators.profile import TARGET, _q, long_values, numeric_columns, string_columns
from lendspark.session import ship_package

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for the same results)
# ---------------------------------------------------------------------------
ALPHA = 0.05
TEST_CHI2 = "Qui-Quadrado"
TEST_MWU = "Mann-Whitney U"
TEST_KS = "Kolmogorov-Smirnov"
STATUS_REJECT = "REJEITA H0"
STATUS_KEEP = "NAO REJEITA H0"
# Conclusion texts; %s placeholders are filled with Java-style format_string.
CHI2_YES = "'%s' tem associação significativa com inadimplência (p=%.2e < %s)."
CHI2_NO = "'%s' não tem associação significativa com inadimplência (p=%.2e >= %s)."
MWU_YES = ("'%s' difere significativamente entre grupos "
           "(mediana pagador=%.2f, inadimplente=%.2f; p=%.2e < %s).")
MWU_NO = "'%s' não difere significativamente entre grupos (p=%.2e >= %s)."
KS_YES = ("'%s' tem distribuições estatisticamente diferentes entre grupos "
          "(KS=%.4f; p=%.2e < %s). Boa candidata como feature preditiva.")
KS_NO = ("'%s' não apresenta diferença distribucional significativa "
         "entre grupos (p=%.2e >= %s).")
RECORD_FORMAT = "[%s] %s\n  Estatística = %.4f | p-valor = %.4e\n  %s (alpha=%s) → %s"


def _mwu_p(u0: pd.Series, n0: pd.Series, n1: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([tails.mann_whitney_p(float(u), int(a), int(b), float(t))
                      for u, a, b, t in zip(u0, n0, n1, ties)], dtype="float64")


def _ks_p(d: pd.Series, n0: pd.Series, n1: pd.Series) -> pd.Series:
    return pd.Series([tails.ks_2samp_p(float(x), int(a), int(b)) for x, a, b in zip(d, n0, n1)],
                     dtype="float64")


def _record(df: DataFrame, name: str, stat: Column, p: Column, alpha: float,
            yes: Column, no: Column) -> DataFrame:
    rej = p < F.lit(alpha)
    return df.select(
        F.lit(name).alias("nome_teste"), F.col("coluna").alias("variavel"),
        round_half_even(stat, 4).alias("estatistica"), round_half_even(p, 6).alias("p_valor"),
        F.lit(float(alpha)).alias("alpha"), rej.alias("rejeita_h0"),
        F.when(rej, yes).otherwise(no).alias("conclusao"))


def _alpha_text(alpha: float) -> Column:
    return F.lit(repr(float(alpha)))


def chi2_tests(df: DataFrame, columns: Sequence[str], target: str = TARGET,
               alpha: float = ALPHA) -> DataFrame:
    """G1 over many categorical columns in one job."""
    chi = chi2_by_column(df, columns, target).withColumn(
        "_p", scalar_udf(df.sparkSession, _chi2_p)(F.col("chi2"), F.col("dof")))
    a = _alpha_text(alpha)
    return _record(chi, TEST_CHI2, F.col("chi2"), F.col("_p"), alpha,
                   F.format_string(CHI2_YES, F.col("coluna"), F.col("_p"), a),
                   F.format_string(CHI2_NO, F.col("coluna"), F.col("_p"), a))


def chi2_test(df: DataFrame, column: str, target: str = TARGET, alpha: float = ALPHA) -> DataFrame:
    return chi2_tests(df, [column], target, alpha)


def _separation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    lv = long_values(df.where(_q(target).isNotNull()), columns, keep=[target])
    return class_separation(lv, "value", F.col(target), groups=["column"])


def mann_whitney_tests(df: DataFrame, columns: Sequence[str], target: str = TARGET,
                       alpha: float = ALPHA, with_medians: bool = True,
                       min_distinct: int = 0) -> DataFrame:
    """G2 over many continuous columns in one job. U is that of class 0 (two
    sided; exact for a class of up to 8 rows without ties, else the normal
    approximation with tie and continuity correction). Columns
    where one class is empty are skipped (the reference's test raises)."""
    sep = _separation(df, columns, target).where(
        (F.col("n0") > 0) & (F.col("n1") > 0) & (F.col("n_distinct") > min_distinct))
    sep = sep.withColumn("_p", scalar_udf(df.sparkSession, _mwu_p)("u0", "n0", "n1", "tie_term"))
    if with_medians:
        lv = long_values(df.where(_q(target).isNotNull()), columns, keep=[target])
        med = exact_quantiles(lv, "value", [0.5], groups=["column", target], names=["m"])
        med = med.groupBy("column").agg(
            F.first(F.when(_q(target) == 0, F.col("m")), ignorenulls=True).alias("median_0"),
            F.first(F.when(_q(target) == 1, F.col("m")), ignorenulls=True).alias("median_1"))
        sep = sep.join(med, "column", "left")
    else:
        sep = sep.withColumn("median_0", F.lit(None).cast("double")).withColumn(
            "median_1", F.lit(None).cast("double"))
    sep = sep.withColumnRenamed("column", "coluna")
    a = _alpha_text(alpha)
    rec = _record(sep, TEST_MWU, F.col("u0"), F.col("_p"), alpha,
                  F.format_string(MWU_YES, F.col("coluna"), F.col("median_0"), F.col("median_1"),
                                  F.col("_p"), a),
                  F.format_string(MWU_NO, F.col("coluna"), F.col("_p"), a))
    return rec


def mann_whitney_test(df: DataFrame, column: str, target: str = TARGET, alpha: float = ALPHA) -> DataFrame:
    return mann_whitney_tests(df, [column], target, alpha)


def ks_tests(df: DataFrame, columns: Sequence[str], target: str = TARGET,
             alpha: float = ALPHA) -> DataFrame:
    """Two-sample KS D = max |F0 - F1| per column; p exact for classes of up to
    10,000 rows, else asymptotic."""
    sep = (_separation(df, columns, target).where((F.col("n0") > 0) & (F.col("n1") > 0))
           .withColumnRenamed("column", "coluna"))
    sep = sep.withColumn("_p", scalar_udf(df.sparkSession, _ks_p)("ks", "n0", "n1"))
    a = _alpha_text(alpha)
    return _record(sep, TEST_KS, F.col("ks"), F.col("_p"), alpha,
                   F.format_string(KS_YES, F.col("coluna"), F.col("ks"), F.col("_p"), a),
                   F.format_string(KS_NO, F.col("coluna"), F.col("_p"), a))


def ks_test(df: DataFrame, column: str, target: str = TARGET, alpha: float = ALPHA) -> DataFrame:
    return ks_tests(df, [column], target, alpha)


def test_battery(df: DataFrame, continuous: Sequence[str] | None = None,
                 categorical: Sequence[str] | None = None, target: str = TARGET,
                 alpha: float = ALPHA) -> DataFrame:
    """Mann-Whitney on continuous columns and chi-square on categorical
    ones; ``variavel, teste, estatistica, p_valor, rejeita_h0`` by ascending p.
    Without lists: continuous = numeric columns with > 2 distinct values,
    categorical = string columns (ids are tested too unless excluded)."""
    min_distinct = 0
    if continuous is None:
        # every numeric column; the ordered counts give each column's distinct
        # count for free, so "> 2 distinct values" is applied to the result
        continuous = numeric_columns(df, exclude=[target])
        min_distinct = 2
    if categorical is None:
        categorical = string_columns(df, exclude=[target])
    parts = []
    if continuous:
        parts.append(mann_whitney_tests(df, continuous, target, alpha, with_medians=False,
                                        min_distinct=min_distinct))
    if categorical:
        parts.append(chi2_tests(df, categorical, target, alpha))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "variavel string, teste string, estatistica double, p_valor double, rejeita_h0 boolean")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.select("variavel", F.col("nome_teste").alias("teste"), "estatistica", "p_valor",
                       "rejeita_h0")
               .orderBy("p_valor", "variavel"))


def render(records: DataFrame) -> DataFrame:
    """The printable form of each record."""
    status = F.when(F.col("rejeita_h0"), F.lit(STATUS_REJECT)).otherwise(F.lit(STATUS_KEEP))
    return records.select("*", F.format_string(
        RECORD_FORMAT, F.col("nome_teste"), F.col("variavel"), F.col("estatistica"),
        F.col("p_valor"), status, F.col("alpha").cast("string"), F.col("conclusao")).alias("texto"))


def significance_summary(battery: DataFrame) -> DataFrame:
    """Significant / not-significant counts and shares."""
    return battery.agg(
        F.count(F.lit(1)).alias("n_testes"),
        F.count_if(F.col("rejeita_h0")).alias("n_significativos"),
        F.count_if(~F.col("rejeita_h0")).alias("n_nao_significativos"),
        (F.count_if(F.col("rejeita_h0")) / F.count(F.lit(1))).alias("pct_significativos"))
