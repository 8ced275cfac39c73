"""Feature operators.

``AnomalyHandler`` and ``DomainFeatureBuilder`` are ``pyspark.ml`` Transformers
(persistable, usable inside a ``Pipeline``); each is one projection, so they
fuse into the scan's whole-stage codegen. History enrichment is a hash
aggregate per history table (map-side partial aggregation) followed by left
joins on the applicant key; Spark/AQE choose broadcast or sort-merge from
measured sizes.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendspark.functions.nulls import floor_at_zero, safe_ratio, sum_or_zero
from lendspark.functions.scalar import (DAYS_IN_YEAR, FEATURE_DESCRIPTIONS,
                                        SENTINEL_DAYS_EMPLOYED, domain_feature_columns)


def _require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"Column(s) {missing} not found in the DataFrame.")


# ---------------------------------------------------------------------------
# B1 sentinel cleaning
# ---------------------------------------------------------------------------

class AnomalyHandler(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Sentinel value -> null, plus a byte flag ``<col>_ANOMALY``.

    Comparison is null-safe: a null input gives flag 0, not null."""

    inputCol = Param(Params._dummy(), "inputCol", "column holding the sentinel",
                     typeConverter=TypeConverters.toString)
    sentinel = Param(Params._dummy(), "sentinel", "sentinel value",
                     typeConverter=TypeConverters.toFloat)
    flagCol = Param(Params._dummy(), "flagCol", "name of the flag column",
                    typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol: str = "DAYS_EMPLOYED", sentinel: float = SENTINEL_DAYS_EMPLOYED,
                 flagCol: str | None = None):
        super().__init__()
        self._setDefault(inputCol="DAYS_EMPLOYED", sentinel=float(SENTINEL_DAYS_EMPLOYED),
                         flagCol="DAYS_EMPLOYED_ANOMALY")
        kwargs = self._input_kwargs
        if kwargs.get("flagCol") is None:
            kwargs.pop("flagCol", None)
            kwargs["flagCol"] = f"{inputCol}_ANOMALY"
        self._set(**kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.getOrDefault(self.inputCol)
        s = self.getOrDefault(self.sentinel)
        _require(df, c)
        hit = F.col(c).eqNullSafe(F.lit(s))
        return df.withColumns({
            self.getOrDefault(self.flagCol): hit.cast("byte"),
            c: F.when(hit, F.lit(None)).otherwise(F.col(c)).cast("double"),
        })


# ---------------------------------------------------------------------------
# B2 domain features, B3 feature dictionary
# ---------------------------------------------------------------------------

class DomainFeatureBuilder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Seven derived ratios / durations in one projection."""

    creditCol = Param(Params._dummy(), "creditCol", "credit amount", TypeConverters.toString)
    incomeCol = Param(Params._dummy(), "incomeCol", "income", TypeConverters.toString)
    annuityCol = Param(Params._dummy(), "annuityCol", "annuity", TypeConverters.toString)
    birthCol = Param(Params._dummy(), "birthCol", "days of birth (negative)", TypeConverters.toString)
    employedCol = Param(Params._dummy(), "employedCol", "days employed (negative)", TypeConverters.toString)
    familyCol = Param(Params._dummy(), "familyCol", "family members", TypeConverters.toString)
    daysInYear = Param(Params._dummy(), "daysInYear", "days per year", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, creditCol="AMT_CREDIT", incomeCol="AMT_INCOME_TOTAL",
                 annuityCol="AMT_ANNUITY", birthCol="DAYS_BIRTH",
                 employedCol="DAYS_EMPLOYED", familyCol="CNT_FAM_MEMBERS",
                 daysInYear=DAYS_IN_YEAR):
        super().__init__()
        self._setDefault(creditCol="AMT_CREDIT", incomeCol="AMT_INCOME_TOTAL",
                         annuityCol="AMT_ANNUITY", birthCol="DAYS_BIRTH",
                         employedCol="DAYS_EMPLOYED", familyCol="CNT_FAM_MEMBERS",
                         daysInYear=DAYS_IN_YEAR)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        cols = [g(self.creditCol), g(self.incomeCol), g(self.annuityCol), g(self.birthCol),
                g(self.employedCol), g(self.familyCol)]
        _require(df, *cols)
        return df.withColumns(domain_feature_columns(*cols, days_in_year=g(self.daysInYear)))

    @staticmethod
    def feature_descriptions(spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(FEATURE_DESCRIPTIONS), "feature string, descricao string")


# ---------------------------------------------------------------------------
# D1-D10 history aggregates
# ---------------------------------------------------------------------------

def bureau_aggregates(bureau: DataFrame, key: str = "SK_ID_CURR", id_col: str = "SK_ID_BUREAU",
                      status_col: str = "CREDIT_ACTIVE", active_value: str = "Active",
                      amount_col: str = "AMT_CREDIT_SUM", days_col: str = "DAYS_CREDIT") -> DataFrame:
    _require(bureau, key, id_col, status_col, amount_col, days_col)
    return (bureau.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(id_col).alias("bureau_loan_count"),
        F.count_if(F.col(status_col).eqNullSafe(F.lit(active_value))).alias("bureau_active_loans"),
        sum_or_zero(F.col(amount_col).cast("double")).alias("bureau_total_credit_sum"),
        F.avg(days_col).alias("bureau_mean_days_credit")))


def card_aggregates(card: DataFrame, key: str = "SK_ID_CURR", balance_col: str = "AMT_BALANCE",
                    limit_col: str = "AMT_CREDIT_LIMIT_ACTUAL",
                    drawings_col: str = "AMT_DRAWINGS_CURRENT") -> DataFrame:
    _require(card, key, balance_col, limit_col, drawings_col)
    return (card.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(safe_ratio(balance_col, limit_col)).alias("cc_utilization_mean"),
        sum_or_zero(F.col(drawings_col).cast("double")).alias("cc_drawings_total"),
        F.count_if(F.col(balance_col) > 0).alias("cc_months_with_balance")))


def installment_aggregates(inst: DataFrame, key: str = "SK_ID_CURR", payment_col: str = "AMT_PAYMENT",
                           instalment_col: str = "AMT_INSTALMENT",
                           entry_col: str = "DAYS_ENTRY_PAYMENT",
                           due_col: str = "DAYS_INSTALMENT") -> DataFrame:
    _require(inst, key, payment_col, instalment_col, entry_col, due_col)
    late = floor_at_zero(F.col(entry_col) - F.col(due_col))
    return (inst.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(safe_ratio(payment_col, instalment_col)).alias("install_payment_ratio_mean"),
        F.avg(late).alias("install_days_late_mean"),
        F.count_if(late > 0).alias("install_late_count")))


def enrich_with_history(app: DataFrame, bureau: DataFrame | None = None,
                        credit_card: DataFrame | None = None,
                        installments: DataFrame | None = None,
                        key: str = "SK_ID_CURR") -> DataFrame:
    """C4: left-join any subset of the three history aggregates.

    Each aggregate is unique per key, so the application row count is kept.
    No imputation: applicants without history get nulls. A non-key column
    name present on both sides raises instead of being suffixed.
    """
    _require(app, key)
    out = app
    for hist, fn in ((bureau, bureau_aggregates), (credit_card, card_aggregates),
                     (installments, installment_aggregates)):
        if hist is None:
            continue
        _require(hist, key)
        agg = fn(hist, key=key)
        clash = (set(agg.columns) - {key}) & set(out.columns)
        if clash:
            raise ValueError(f"Columns {sorted(clash)} exist on both sides of the join.")
        out = out.join(agg, key, "left")
    return out


class AuxiliaryFeatureBuilder(Transformer):
    """Transformer form of :func:`enrich_with_history` (holds DataFrames, so
    it is not persistable; use it before the persisted pipeline)."""

    def __init__(self, bureau: DataFrame | None = None, credit_card: DataFrame | None = None,
                 installments: DataFrame | None = None, key: str = "SK_ID_CURR"):
        super().__init__()
        self.bureau, self.credit_card, self.installments, self.key = bureau, credit_card, installments, key

    def _transform(self, df: DataFrame) -> DataFrame:
        return enrich_with_history(df, self.bureau, self.credit_card, self.installments, key=self.key)


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    """Semi-join — rows whose key is in ``ids`` (write it before a groupBy
    so the filter runs before aggregation)."""
    return df.join(ids.select(key), key, "left_semi")


def select_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep the declared columns that exist, in declared order."""
    return df.select(*[c for c in columns if c in df.columns])
