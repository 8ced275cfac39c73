"""Row-level derived columns: domain ratios, score band, decision, binning.

All expressions are built-in Spark functions, so they stay inside whole-stage
codegen; none needs a UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendspark.functions.nulls import col_of, safe_ratio

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for the same results)
# ---------------------------------------------------------------------------
SENTINEL_DAYS_EMPLOYED = 365243
DAYS_IN_YEAR = 365.25
DEFAULT_THRESHOLD = 0.5
BAND_EDGES = (0.20, 0.40, 0.60, 0.80)
BAND_LABELS = ("A", "B", "C", "D", "E")
DECISION_APPROVED = "APROVADO"
DECISION_DENIED = "NEGADO"
RATIO_BIN_EDGES = (0, 1, 2, 4, 8, 100)
RATIO_BIN_LABELS = ("0-1x", "1-2x", "2-4x", "4-8x", ">8x")
FEATURE_DESCRIPTIONS = (
    ("CREDIT_INCOME_RATIO", "Crédito total / Renda anual. Razão alta indica superendividamento."),
    ("ANNUITY_INCOME_RATIO", "Parcela mensal / Renda anual. Mede o comprometimento de renda."),
    ("CREDIT_TERM_MONTHS", "Crédito / Parcela. Prazo implícito do empréstimo em meses."),
    ("INCOME_PER_FAMILY_MEMBER", "Renda / Membros da família. Proxy de capacidade de pagamento real."),
    ("AGE_YEARS", "Idade do cliente convertida de dias para anos."),
    ("EMPLOYED_YEARS", "Tempo de emprego convertido de dias para anos (após limpeza de anomalia)."),
    ("EMPLOYED_TO_AGE_RATIO", "Tempo empregado / Idade. Estabilidade relativa no emprego."),
)


def days_to_years(days: str | Column, days_in_year: float = DAYS_IN_YEAR) -> Column:
    """Negative day offsets -> positive years (``days / -365.25``)."""
    return col_of(days).cast("double") / F.lit(-float(days_in_year))


def domain_feature_columns(credit: str = "AMT_CREDIT",
                           income: str = "AMT_INCOME_TOTAL",
                           annuity: str = "AMT_ANNUITY",
                           birth_days: str = "DAYS_BIRTH",
                           employed_days: str = "DAYS_EMPLOYED",
                           family: str = "CNT_FAM_MEMBERS",
                           days_in_year: float = DAYS_IN_YEAR) -> dict[str, Column]:
    """The seven derived features as named column expressions.

    Zero denominators give null (the reference guards annuity and family size;
    for income and age it would yield +-inf, which we also map to null)."""
    age = days_to_years(birth_days, days_in_year)
    employed = days_to_years(employed_days, days_in_year)
    return {
        "CREDIT_INCOME_RATIO": safe_ratio(credit, income),
        "ANNUITY_INCOME_RATIO": safe_ratio(annuity, income),
        "CREDIT_TERM_MONTHS": safe_ratio(credit, annuity),
        "AGE_YEARS": age,
        "EMPLOYED_YEARS": employed,
        "EMPLOYED_TO_AGE_RATIO": F.try_divide(employed, age),
        "INCOME_PER_FAMILY_MEMBER": safe_ratio(income, family),
    }


def score_band(prob: str | Column, edges: Sequence[float] = BAND_EDGES,
               labels: Sequence[str] = BAND_LABELS) -> Column:
    """A < .2 <= B < .4 <= C < .6 <= D < .8 <= E, on the unrounded probability."""
    p = col_of(prob)
    expr = F.when(p.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        expr = expr.when(p < F.lit(edge), F.lit(label))
    return expr.otherwise(F.lit(labels[len(edges)]))


def decision(prob: str | Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Denied when p >= threshold, else approved."""
    p = col_of(prob)
    return (F.when(p.isNull(), F.lit(None).cast("string"))
             .when(p >= F.lit(threshold), F.lit(DECISION_DENIED))
             .otherwise(F.lit(DECISION_APPROVED)))


def right_closed_bin(x: str | Column, edges: Sequence[float] = RATIO_BIN_EDGES,
                     labels: Sequence[str] | None = RATIO_BIN_LABELS) -> Column:
    """``pd.cut`` with right-closed intervals (a, b]; outside -> null.

    Returns the label, or the 0-based bin index when ``labels`` is None."""
    v = col_of(x)
    expr = None
    for i in range(len(edges) - 1):
        cond = (v > F.lit(edges[i])) & (v <= F.lit(edges[i + 1]))
        out = F.lit(labels[i]) if labels is not None else F.lit(i)
        expr = F.when(cond, out) if expr is None else expr.when(cond, out)
    return expr


def label_map(c: str | Column, mapping: dict) -> Column:
    """Constants-to-label map (e.g. 0/1 -> text); unmapped -> null."""
    v = col_of(c)
    expr = None
    for k, lab in mapping.items():
        expr = F.when(v == F.lit(k), F.lit(lab)) if expr is None else expr.when(v == F.lit(k), F.lit(lab))
    return expr
