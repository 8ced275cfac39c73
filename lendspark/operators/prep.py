"""Preprocessing estimators, sampling and fold assignment.

* ``NumericImputerScaler``: exact median imputation (distributed ordered
  counts, not Spark's approximate ``Imputer``) followed by standard scaling
  with the population std of the imputed column; a constant column keeps
  scale 1.
* ``ModeImputer``: most frequent string per column, ties to the smallest.
* ``build_preprocessor``: one ``Pipeline`` from raw rows to a ``features``
  vector (sentinel -> derived ratios -> impute/scale -> impute/one-hot),
  the same object used by cross-validation, the final fit and scoring.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendspark.operators.features import AnomalyHandler, DomainFeatureBuilder
from lendspark.operators.ordered import hashed_row_numbers, ordered_counts
from lendspark.operators.profile import _long_stats, _q, column_medians

RANDOM_STATE = 42


class NumericImputerScalerModel(Model, HasInputCols, HasOutputCols,
                                DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "fitted medians", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "fitted means after imputation", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "fitted population std (1 if 0)", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, medians=None, means=None, scales=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        exprs = {}
        for c, o, m, mu, s in zip(g(self.inputCols), g(self.outputCols), g(self.medians),
                                  g(self.means), g(self.scales)):
            exprs[o] = (F.coalesce(_q(c).cast("double"), F.lit(m)) - F.lit(mu)) / F.lit(s)
        return df.withColumns(exprs)


class NumericImputerScaler(Estimator, HasInputCols, HasOutputCols,
                           DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> NumericImputerScalerModel:
        """The exact medians, and one pass for each column's non-null count, mean and
        population variance. The imputed column's mean / variance then follow exactly from
        the parallel-variance combination (Chan, Golub & LeVeque) of the non-null values
        with n_null copies of the median, without a pass of their own."""
        cols = self.getInputCols()
        outs = self.getOutputCols() if self.isSet(self.outputCols) else cols
        x = F.col("value")
        stats = _long_stats(df, cols, {
            "_n": F.count(x), "_rows": F.count(F.lit(1)), "_mean": F.avg(x), "_var": F.var_pop(x)})
        med = column_medians(df, cols)
        st = {r["column"]: r for r in stats.collect()}              # one row per column
        medians, means, scales = [], [], []
        for c in cols:
            m = float(med[c]) if med.get(c) is not None else 0.0
            r = st.get(c)
            n_a = float(r["_n"]) if r else 0.0
            total = float(r["_rows"]) if r else 0.0
            n_b = total - n_a
            mean_a = float(r["_mean"]) if r and r["_mean"] is not None else m
            m2_a = float(r["_var"]) * n_a if r and r["_var"] is not None else 0.0
            mean = (n_a * mean_a + n_b * m) / total if total else 0.0
            m2 = m2_a + (m - mean_a) ** 2 * n_a * n_b / total if total else 0.0
            std = math.sqrt(max(m2 / total, 0.0)) if total else 0.0
            medians.append(m)
            means.append(mean)
            scales.append(std if std > 0 else 1.0)
        return NumericImputerScalerModel(inputCols=cols, outputCols=outs, medians=medians,
                                         means=means, scales=scales)


class ModeImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    modes = Param(Params._dummy(), "modes", "most frequent value per column", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, modes=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        return df.withColumns({o: F.coalesce(_q(c).cast("string"), F.lit(m))
                               for c, o, m in zip(g(self.inputCols), g(self.outputCols), g(self.modes))})


class ModeImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Most-frequent imputation for string columns (Spark's ``Imputer`` only
    takes numbers). One job: counts per (column, value), then the top value
    per column with ties to the smallest."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        cols = self.getInputCols()
        outs = self.getOutputCols() if self.isSet(self.outputCols) else cols
        long = (df.select(*[_q(c).cast("string").alias(c) for c in cols])
                  .unpivot([], cols, "column", "value").where(F.col("value").isNotNull()))
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        top = counts.groupBy("column").agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")).collect()
        modes = {r["column"]: r["mode"] for r in top}  # one row per column
        return ModeImputerModel(inputCols=cols, outputCols=outs,
                                modes=[modes.get(c) or "" for c in cols])


def build_preprocessor(numeric_cols: Sequence[str], categorical_cols: Sequence[str],
                       features_col: str = "features", with_anomaly: bool = True,
                       with_domain: bool = True, anomaly_kwargs: dict | None = None,
                       domain_kwargs: dict | None = None) -> Pipeline:
    """L1: B1 -> B2 -> (median impute + scale) -> (mode impute + one-hot) ->
    assembled vector. Only declared columns reach the vector (B6).

    One-hot keeps every training level in alphabetical order; an unseen
    level at scoring gets all zeros (StringIndexer ``keep`` puts it in the
    last slot, which ``dropLast`` removes)."""
    stages = []
    if with_anomaly:
        stages.append(AnomalyHandler(**(anomaly_kwargs or {})))
    if with_domain:
        stages.append(DomainFeatureBuilder(**(domain_kwargs or {})))
    num_out = [f"{c}__num" for c in numeric_cols]
    vec_inputs = []
    if numeric_cols:
        stages.append(NumericImputerScaler(inputCols=list(numeric_cols), outputCols=num_out))
        vec_inputs += num_out
    if categorical_cols:
        imp = [f"{c}__imp" for c in categorical_cols]
        idx = [f"{c}__idx" for c in categorical_cols]
        ohe = [f"{c}__ohe" for c in categorical_cols]
        stages += [ModeImputer(inputCols=list(categorical_cols), outputCols=imp),
                   StringIndexer(inputCols=imp, outputCols=idx, stringOrderType="alphabetAsc",
                                 handleInvalid="keep"),
                   OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True)]
        vec_inputs += ohe
    stages.append(VectorAssembler(inputCols=vec_inputs, outputCol=features_col))
    return Pipeline(stages=stages)


def passthrough() -> Pipeline:
    """The identity pipeline."""
    return Pipeline(stages=[])


def feature_names(model) -> list[str]:
    """Names of the assembled vector's slots: numeric columns, then
    ``<column>_<level>`` per one-hot slot (reference naming)."""
    from pyspark.ml.feature import StringIndexerModel
    names: list[str] = []
    stages = model.stages
    for st in stages:
        if isinstance(st, NumericImputerScalerModel):
            names += list(st.getInputCols())
    for st in stages:
        if isinstance(st, StringIndexerModel):
            for col, labels in zip(st.getInputCols(), st.labelsArray):
                base = col[:-len("__imp")] if col.endswith("__imp") else col
                names += [f"{base}_{lv}" for lv in labels]
    return names


def processed_frame(model, df: DataFrame, keep: Sequence[str] = ("SK_ID_CURR", "TARGET"),
                    features_col: str = "features") -> DataFrame:
    """The model matrix as named double columns plus id / label (carried
    through the pipeline, never re-attached by position)."""
    names = feature_names(model)
    out = model.transform(df).withColumn("_arr", vector_to_array(features_col))
    keep = [k for k in keep if k in df.columns]
    return out.select(*[_q(k) for k in keep],
                      *[F.col("_arr")[i].alias(n) for i, n in enumerate(names)])


# ---------------------------------------------------------------------------
# Sampling and folds
# ---------------------------------------------------------------------------

def _hash_key(id_col: str | Column, seed: int) -> Column:
    """Order key of a row: the first 60 bits of the MD5 of ``id:seed``, which any
    engine computes alike."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.concat(c.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = RANDOM_STATE) -> DataFrame:
    """A seeded sample of exactly ``n`` rows (hash order, top-k per
    partition then merge; no full sort)."""
    return df.orderBy(_hash_key(id_col, seed), F.col(id_col)).limit(n)


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = 0.2,
                     seed: int = RANDOM_STATE, out: str = "split") -> DataFrame:
    """Per class, the first round(test_size * n_class) rows in hash order
    are ``test``, the rest ``train``; rows without a label are dropped. Only (label,
    hash) is ordered, to find each class's last test hash; the rows themselves are
    compared with it where they are. Rows of one id fall on the same side."""
    key = _hash_key(id_col, seed)
    order = ordered_counts(df.select(F.col(label).alias("_class"), key.alias("_k")).where(F.col(label).isNotNull()),
                           "_k", groups=["_class"], value_name="_k")
    n_test = F.floor(F.col("total_n") * F.lit(test_size) + F.lit(0.5))
    last = order.groupBy("_class").agg(F.max(F.when(F.col("before_n") < n_test, F.col("_k"))).alias("_last"))
    side = F.when(key <= F.col("_last"), F.lit("test")).otherwise(F.lit("train"))
    return df.join(last, F.col(label) == F.col("_class")).withColumn(out, side).drop("_class", "_last")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5,
                     seed: int = RANDOM_STATE, out: str = "fold") -> DataFrame:
    """fold = (rank within class in hash order) mod k, so every fold has
    each class within one row of n_class / k."""
    ranked = hashed_row_numbers(df, [label], _hash_key(id_col, seed), out="_rk")
    return ranked.withColumn(out, (F.col("_rk") % k).cast("int")).drop("_rk", "_group_n")
