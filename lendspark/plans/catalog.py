"""Registered queries over the driver's test tables, with DuckDB oracle SQL.

Every query reads whole tables (through the role views of
:mod:`lendspark.sources.roles`) and returns a DataFrame whose column names
match the oracle SQL. Floating outputs are rounded half-even on both sides
(binary half-even with a tie nudge, see ``round_half_even``) so the engines' summation order cannot flip a
hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendspark.functions.nulls import round_half_even, stable_round_sql
from lendspark.operators import features as feat
from lendspark.operators import profile as prof
from lendspark.session import cut_lineage, shared_path
from lendspark.sources import io, roles
from lendspark.sources.roles import (APPLICATION_SQL, BUREAU_SQL, CREDIT_CARD_SQL,
                                     INSTALLMENTS_SQL, SCORES_SQL, with_sql)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = stable_round_sql(sql.strip())
        return fn
    return deco


def r4(c):
    return round_half_even(c, 4)


def r2(c):
    return round_half_even(c, 2)


def r6(c):
    return round_half_even(c, 6)


def enriched(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    """Applications joined with all three history aggregates. Queries that
    pass over it several times materialize it once (reliable checkpoint in
    the shared folder) instead of recomputing the joins per pass."""
    e = feat.enrich_with_history(
        roles.application(spark, sf_dir),
        bureau=roles.bureau(spark, sf_dir),
        credit_card=roles.credit_card(spark, sf_dir),
        installments=roles.installments(spark, sf_dir))
    return cut_lineage(e) if materialize else e


_AGG_SQL = """
bureau_agg AS (
  SELECT SK_ID_CURR,
         count(SK_ID_BUREAU) AS bureau_loan_count,
         count(*) FILTER (WHERE CREDIT_ACTIVE = 'Active') AS bureau_active_loans,
         coalesce(sum(AMT_CREDIT_SUM), 0) AS bureau_total_credit_sum,
         avg(DAYS_CREDIT) AS bureau_mean_days_credit
  FROM bureau WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR
),
card_agg AS (
  SELECT SK_ID_CURR,
         avg(AMT_BALANCE / nullif(AMT_CREDIT_LIMIT_ACTUAL, 0)) AS cc_utilization_mean,
         coalesce(sum(AMT_DRAWINGS_CURRENT), 0) AS cc_drawings_total,
         count(*) FILTER (WHERE AMT_BALANCE > 0) AS cc_months_with_balance
  FROM credit_card WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR
),
inst_late AS (
  SELECT SK_ID_CURR, AMT_PAYMENT / nullif(AMT_INSTALMENT, 0) AS ratio,
         CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT < 0 THEN 0.0
              ELSE DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT END AS late
  FROM installments WHERE SK_ID_CURR IS NOT NULL
),
inst_agg AS (
  SELECT SK_ID_CURR, avg(ratio) AS install_payment_ratio_mean,
         avg(late) AS install_days_late_mean,
         count(*) FILTER (WHERE late > 0) AS install_late_count
  FROM inst_late GROUP BY SK_ID_CURR
),
enriched AS (
  SELECT a.*, b.* EXCLUDE (SK_ID_CURR), c.* EXCLUDE (SK_ID_CURR), i.* EXCLUDE (SK_ID_CURR)
  FROM application a
  LEFT JOIN bureau_agg b USING (SK_ID_CURR)
  LEFT JOIN card_agg c USING (SK_ID_CURR)
  LEFT JOIN inst_agg i USING (SK_ID_CURR)
)"""

ENRICHED_WITH = with_sql(APPLICATION_SQL, BUREAU_SQL, CREDIT_CARD_SQL, INSTALLMENTS_SQL, _AGG_SQL)

HISTORY_COLS = ["bureau_loan_count", "bureau_active_loans", "bureau_total_credit_sum",
                "bureau_mean_days_credit", "cc_utilization_mean", "cc_drawings_total",
                "cc_months_with_balance", "install_payment_ratio_mean",
                "install_days_late_mean", "install_late_count"]


# ---------------------------------------------------------------------------
# Flagship: enrich with history, default rate per segment (C4 + D1-D10 + D11)
# ---------------------------------------------------------------------------

def _rate_cols():
    return ["categoria", "n_clientes", "n_inadimplentes", "taxa_inadimplencia_pct",
            "diferenca_media_pct"]


def _rate_sql(source_with: str, table: str, column: str, min_samples: int) -> str:
    return source_with + f"""
, overall AS (SELECT avg(TARGET) * 100 AS m FROM {table}),
g AS (
  SELECT {column} AS categoria, count(TARGET) AS n_clientes,
         CAST(coalesce(sum(TARGET), 0) AS BIGINT) AS n_inadimplentes
  FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}
)
SELECT categoria, n_clientes, n_inadimplentes,
       round_even(n_inadimplentes * 100.0 / n_clientes, 2) AS taxa_inadimplencia_pct,
       round_even(round_even(n_inadimplentes * 100.0 / n_clientes, 2) - m, 2) AS diferenca_media_pct
FROM g, overall WHERE n_clientes >= {min_samples}
ORDER BY taxa_inadimplencia_pct DESC, categoria
"""


@register("default_rate_by_active_loans",
          _rate_sql(ENRICHED_WITH, "enriched", "bureau_active_loans", 30))
def q_default_rate_by_active_loans(spark, sf_dir):
    return prof.default_rate_by_group(enriched(spark, sf_dir), "bureau_active_loans", min_samples=30)


@register("default_rate_by_contract_type",
          _rate_sql(with_sql(APPLICATION_SQL), "application", "NAME_CONTRACT_TYPE", 30))
def q_default_rate_by_contract_type(spark, sf_dir):
    return prof.default_rate_by_group(roles.application(spark, sf_dir), "NAME_CONTRACT_TYPE")


@register("history_enrichment", ENRICHED_WITH + """
SELECT SK_ID_CURR, TARGET, bureau_loan_count, bureau_active_loans,
       round_even(bureau_total_credit_sum, 2) AS bureau_total_credit_sum,
       round_even(bureau_mean_days_credit, 4) AS bureau_mean_days_credit,
       round_even(cc_utilization_mean, 4) AS cc_utilization_mean,
       round_even(cc_drawings_total, 2) AS cc_drawings_total,
       cc_months_with_balance,
       round_even(install_payment_ratio_mean, 4) AS install_payment_ratio_mean,
       round_even(install_days_late_mean, 4) AS install_days_late_mean,
       install_late_count
FROM enriched""")
def q_history_enrichment(spark, sf_dir):
    e = enriched(spark, sf_dir)
    return e.select(
        "SK_ID_CURR", "TARGET", "bureau_loan_count", "bureau_active_loans",
        r2("bureau_total_credit_sum").alias("bureau_total_credit_sum"),
        r4("bureau_mean_days_credit").alias("bureau_mean_days_credit"),
        r4("cc_utilization_mean").alias("cc_utilization_mean"),
        r2("cc_drawings_total").alias("cc_drawings_total"),
        "cc_months_with_balance",
        r4("install_payment_ratio_mean").alias("install_payment_ratio_mean"),
        r4("install_days_late_mean").alias("install_days_late_mean"),
        "install_late_count")


@register("bureau_aggregates", with_sql(BUREAU_SQL, _AGG_SQL.split("card_agg AS")[0].rstrip().rstrip(",")) + """
SELECT SK_ID_CURR, bureau_loan_count, bureau_active_loans,
       round_even(bureau_total_credit_sum, 2) AS bureau_total_credit_sum,
       round_even(bureau_mean_days_credit, 4) AS bureau_mean_days_credit
FROM bureau_agg""")
def q_bureau_aggregates(spark, sf_dir):
    a = feat.bureau_aggregates(roles.bureau(spark, sf_dir))
    return a.select("SK_ID_CURR", "bureau_loan_count", "bureau_active_loans",
                    r2("bureau_total_credit_sum").alias("bureau_total_credit_sum"),
                    r4("bureau_mean_days_credit").alias("bureau_mean_days_credit"))


@register("card_aggregates", with_sql(CREDIT_CARD_SQL) + """
SELECT SK_ID_CURR,
       round_even(avg(AMT_BALANCE / nullif(AMT_CREDIT_LIMIT_ACTUAL, 0)), 4) AS cc_utilization_mean,
       round_even(coalesce(sum(AMT_DRAWINGS_CURRENT), 0), 2) AS cc_drawings_total,
       count(*) FILTER (WHERE AMT_BALANCE > 0) AS cc_months_with_balance
FROM credit_card WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR""")
def q_card_aggregates(spark, sf_dir):
    a = feat.card_aggregates(roles.credit_card(spark, sf_dir))
    return a.select("SK_ID_CURR", r4("cc_utilization_mean").alias("cc_utilization_mean"),
                    r2("cc_drawings_total").alias("cc_drawings_total"), "cc_months_with_balance")


@register("installment_aggregates", with_sql(INSTALLMENTS_SQL) + """
, inst_late AS (
  SELECT SK_ID_CURR, AMT_PAYMENT / nullif(AMT_INSTALMENT, 0) AS ratio,
         CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT < 0 THEN 0.0
              ELSE DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT END AS late
  FROM installments WHERE SK_ID_CURR IS NOT NULL)
SELECT SK_ID_CURR, round_even(avg(ratio), 4) AS install_payment_ratio_mean,
       round_even(avg(late), 4) AS install_days_late_mean,
       count(*) FILTER (WHERE late > 0) AS install_late_count
FROM inst_late GROUP BY SK_ID_CURR""")
def q_installment_aggregates(spark, sf_dir):
    a = feat.installment_aggregates(roles.installments(spark, sf_dir))
    return a.select("SK_ID_CURR", r4("install_payment_ratio_mean").alias("install_payment_ratio_mean"),
                    r4("install_days_late_mean").alias("install_days_late_mean"), "install_late_count")


# ---------------------------------------------------------------------------
# B1 / B2 / B3 / B5 / C5
# ---------------------------------------------------------------------------

@register("anomaly_flag_part_size", """
SELECT p_partkey,
       CAST(CASE WHEN p_size = 50 THEN NULL ELSE p_size END AS DOUBLE) AS p_size,
       CAST(p_size IS NOT DISTINCT FROM 50 AS TINYINT) AS p_size_ANOMALY
FROM part""")
def q_anomaly_flag_part_size(spark, sf_dir):
    part = roles.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return feat.AnomalyHandler(inputCol="p_size", sentinel=roles.PART_SIZE_SENTINEL).transform(part)


@register("anomaly_flag_days_employed", with_sql(APPLICATION_SQL) + """
SELECT SK_ID_CURR,
       CAST(CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END AS DOUBLE) AS DAYS_EMPLOYED,
       CAST(DAYS_EMPLOYED IS NOT DISTINCT FROM 365243 AS TINYINT) AS DAYS_EMPLOYED_ANOMALY
FROM application""")
def q_anomaly_flag_days_employed(spark, sf_dir):
    app = roles.application(spark, sf_dir).select("SK_ID_CURR", "DAYS_EMPLOYED")
    return feat.AnomalyHandler().transform(app)


_DOMAIN_SQL = with_sql(APPLICATION_SQL) + """
, cleaned AS (
  SELECT *, CAST(CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END AS DOUBLE) AS DE
  FROM application)
SELECT SK_ID_CURR,
  round_even(AMT_CREDIT / nullif(AMT_INCOME_TOTAL, 0), 4) AS CREDIT_INCOME_RATIO,
  round_even(AMT_ANNUITY / nullif(AMT_INCOME_TOTAL, 0), 4) AS ANNUITY_INCOME_RATIO,
  round_even(AMT_CREDIT / nullif(AMT_ANNUITY, 0), 4) AS CREDIT_TERM_MONTHS,
  round_even(DAYS_BIRTH / -365.25, 4) AS AGE_YEARS,
  round_even(DE / -365.25, 4) AS EMPLOYED_YEARS,
  round_even((DE / -365.25) / nullif(DAYS_BIRTH / -365.25, 0), 4) AS EMPLOYED_TO_AGE_RATIO,
  round_even(AMT_INCOME_TOTAL / nullif(CNT_FAM_MEMBERS, 0), 4) AS INCOME_PER_FAMILY_MEMBER
FROM cleaned"""

DOMAIN_COLS = ["CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "CREDIT_TERM_MONTHS", "AGE_YEARS",
               "EMPLOYED_YEARS", "EMPLOYED_TO_AGE_RATIO", "INCOME_PER_FAMILY_MEMBER"]


@register("domain_features", _DOMAIN_SQL)
def q_domain_features(spark, sf_dir):
    app = roles.application(spark, sf_dir)
    out = feat.DomainFeatureBuilder().transform(feat.AnomalyHandler().transform(app))
    return out.select("SK_ID_CURR", *[r4(c).alias(c) for c in DOMAIN_COLS])


@register("semi_join_labelled_documents", """
SELECT d.doc_id, d.lang, d.n_chars FROM documents d
WHERE d.doc_id IN (SELECT doc_id FROM labels)""")
def q_semi_join_labelled_documents(spark, sf_dir):
    docs = roles.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return feat.keep_ids(docs, roles.table(spark, sf_dir, "labels"), key="doc_id")


# ---------------------------------------------------------------------------
# Profiles (E1, E3, E5, E8, E10, E11)
# ---------------------------------------------------------------------------

_PROFILE_COLS = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "DAYS_BIRTH",
                 "CNT_FAM_MEMBERS"] + HISTORY_COLS


def _profile_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS coluna,
  round_even(avg({c}), 4) AS media, round_even(median({c}), 4) AS mediana,
  round_even(stddev_samp({c}), 4) AS desvio_padrao, round_even(min({c}), 4) AS minimo,
  round_even(max({c}), 4) AS maximo, round_even(skewness({c}), 4) AS skewness,
  round_even(kurtosis({c}), 4) AS kurtosis,
  round_even(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS pct_nulos,
  count(DISTINCT {c}) AS n_unicos
FROM enriched""")
    return ENRICHED_WITH + "\nUNION ALL\n".join(parts)


@register("numeric_profile", _profile_sql(_PROFILE_COLS))
def q_numeric_profile(spark, sf_dir):
    e = enriched(spark, sf_dir, materialize=True).select("TARGET", *_PROFILE_COLS)
    return prof.numeric_profile(e)


def _nan_lineitem(spark, sf_dir):
    """lineitem with NaN quantities and prices where l_tax is 0, staged as Parquet and
    read back through the library's reader (ingest rule: NaN is missing)."""
    li = roles.table(spark, sf_dir, "lineitem")
    for c in ("l_quantity", "l_extendedprice"):
        li = li.withColumn(c, F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col(c)))
    path = shared_path(spark, f"nan-{uuid.uuid4().hex}")
    return io.read_parquet(spark, io.write_parquet(li, path),
                           ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"])


_NAN_SQL = """WITH enriched AS (
  SELECT l_orderkey, CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice, l_discount FROM lineitem)
"""
_NAN_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@register("numeric_profile_nan", _NAN_SQL + _profile_sql(_NAN_COLS)[len(ENRICHED_WITH):])
def q_numeric_profile_nan(spark, sf_dir):
    return prof.numeric_profile(_nan_lineitem(spark, sf_dir).select(*_NAN_COLS))


@register("null_profile_nan", _NAN_SQL + "\nUNION ALL\n".join(f"""
SELECT '{c}' AS coluna, count(*) FILTER (WHERE {c} IS NULL) AS n_nulos,
  round_even(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS pct_nulos, 'double' AS dtype
FROM enriched HAVING count(*) FILTER (WHERE {c} IS NULL) > 0""" for c in _NAN_COLS))
def q_null_profile_nan(spark, sf_dir):
    return prof.null_profile(_nan_lineitem(spark, sf_dir).select(*_NAN_COLS))


@register("card_aggregates_nan", _NAN_SQL + """
SELECT l_orderkey AS SK_ID_CURR,
       round_even(avg(l_quantity / nullif(l_extendedprice, 0)), 6) AS cc_utilization_mean,
       round_even(coalesce(sum(l_extendedprice), 0), 2) AS cc_drawings_total,
       count(*) FILTER (WHERE l_quantity > 0) AS cc_months_with_balance
FROM enriched GROUP BY l_orderkey""")
def q_card_aggregates_nan(spark, sf_dir):
    card = _nan_lineitem(spark, sf_dir).select(
        F.col("l_orderkey").alias("SK_ID_CURR"), F.col("l_quantity").alias("AMT_BALANCE"),
        F.col("l_extendedprice").alias("AMT_CREDIT_LIMIT_ACTUAL"),
        F.col("l_extendedprice").alias("AMT_DRAWINGS_CURRENT"))
    a = feat.card_aggregates(card)
    return a.select("SK_ID_CURR", r6("cc_utilization_mean").alias("cc_utilization_mean"),
                    r2("cc_drawings_total").alias("cc_drawings_total"), "cc_months_with_balance")


_SKEW_TOP = 10  # the notebook's "top 10 most skewed features" report


def _top_skew_sql(cols, k):
    union = _profile_sql(cols)[len(ENRICHED_WITH):]
    return ENRICHED_WITH + f""", prof AS ({union})
SELECT coluna, media, mediana, desvio_padrao, skewness, pct_nulos FROM prof
ORDER BY skewness DESC NULLS LAST, coluna LIMIT {k}"""


@register("top_skewed_columns", _top_skew_sql(_PROFILE_COLS, _SKEW_TOP))
def q_top_skewed_columns(spark, sf_dir):
    """E1 profile, the k most right-skewed columns (a top-k report)."""
    e = enriched(spark, sf_dir, materialize=True).select("TARGET", *_PROFILE_COLS)
    return (prof.numeric_profile(e)
            .orderBy(F.col("skewness").desc_nulls_last(), "coluna").limit(_SKEW_TOP)
            .select("coluna", "media", "mediana", "desvio_padrao", "skewness", "pct_nulos"))


def _null_profile_sql(cols):
    parts = [f"""
SELECT '{c}' AS coluna, count(*) FILTER (WHERE {c} IS NULL) AS n_nulos,
  round_even(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS pct_nulos,
  '{t}' AS dtype FROM enriched""" for c, t in cols]
    return ENRICHED_WITH + ", np AS (" + "\nUNION ALL\n".join(parts) + """)
SELECT * FROM np WHERE n_nulos > 0 ORDER BY pct_nulos DESC, coluna"""


_NULL_TYPES = [("bureau_loan_count", "bigint"), ("bureau_active_loans", "bigint"),
               ("bureau_total_credit_sum", "double"), ("bureau_mean_days_credit", "double"),
               ("cc_utilization_mean", "double"), ("cc_drawings_total", "double"),
               ("cc_months_with_balance", "bigint"), ("install_payment_ratio_mean", "double"),
               ("install_days_late_mean", "double"), ("install_late_count", "bigint"),
               ("AMT_CREDIT", "double"), ("DAYS_EMPLOYED", "bigint")]


@register("null_profile", _null_profile_sql(_NULL_TYPES))
def q_null_profile(spark, sf_dir):
    e = enriched(spark, sf_dir).select(*[c for c, _ in _NULL_TYPES])
    return prof.null_profile(e)


@register("null_summary", ENRICHED_WITH + """
, np AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS coluna, count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS p FROM enriched"
    for c, _ in _NULL_TYPES) + f""")
SELECT count(*) FILTER (WHERE p > 0) AS columns_with_nulls,
       {len(_NULL_TYPES)} AS total_columns,
       round_even(count(*) FILTER (WHERE p > 0) * 100.0 / {len(_NULL_TYPES)}, 1) AS pct_columns_with_nulls,
       count(*) FILTER (WHERE round_even(p, 2) > 50) AS columns_over_high,
       round_even(sum(CASE WHEN p > 0 THEN round_even(p, 2) ELSE 0 END) / {len(_NULL_TYPES)}, 4) AS mean_null_pct
FROM np""")
def q_null_summary(spark, sf_dir):
    e = enriched(spark, sf_dir).select(*[c for c, _ in _NULL_TYPES])
    s = prof.null_summary(prof.null_profile(e), len(_NULL_TYPES))
    return s.select("columns_with_nulls", F.col("total_columns").cast("int").alias("total_columns"),
                    "pct_columns_with_nulls", "columns_over_high",
                    r4("mean_null_pct").alias("mean_null_pct"))


_DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("describe_lineitem", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column, count({c}) AS count, round_even(avg({c}), 4) AS mean,
  round_even(stddev_samp({c}), 4) AS std, round_even(min({c}), 4) AS min,
  round_even(quantile_cont({c}, 0.25), 4) AS q25, round_even(quantile_cont({c}, 0.5), 4) AS q50,
  round_even(quantile_cont({c}, 0.75), 4) AS q75, round_even(max({c}), 4) AS max
FROM lineitem""" for c in _DESCRIBE_COLS))
def q_describe_lineitem(spark, sf_dir):
    li = roles.table(spark, sf_dir, "lineitem")
    d = prof.describe(li, _DESCRIBE_COLS)
    return d.select("column", "count", *[r4(c).alias(c) for c in
                                         ["mean", "std", "min", "q25", "q50", "q75", "max"]])


@register("duplicate_order_keys_in_lineitem", """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY l_orderkey)""")
def q_duplicate_order_keys_in_lineitem(spark, sf_dir):
    return prof.duplicate_count(roles.table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@register("base_rate", with_sql(APPLICATION_SQL) + """
SELECT round_even(avg(TARGET), 6) AS base_rate, count(TARGET) AS n FROM application""")
def q_base_rate(spark, sf_dir):
    b = prof.base_rate(roles.application(spark, sf_dir))
    return b.select(r6("base_rate").alias("base_rate"), "n")


@register("derived_checks", _DOMAIN_SQL.split("SELECT SK_ID_CURR,")[0] + """
SELECT count(*) FILTER (WHERE DE IS NULL) AS employed_nulls,
       count(*) FILTER (WHERE DAYS_EMPLOYED = 365243) AS sentinel_rows,
       count(*) FILTER (WHERE nullif(AMT_ANNUITY, 0) IS NULL) AS term_nulls,
       count(*) FILTER (WHERE nullif(CNT_FAM_MEMBERS, 0) IS NULL) AS per_capita_nulls
FROM cleaned""")
def q_derived_checks(spark, sf_dir):
    app = roles.application(spark, sf_dir)
    d = feat.DomainFeatureBuilder().transform(feat.AnomalyHandler().transform(app))
    return prof.count_checks(d, {
        "employed_nulls": F.col("DAYS_EMPLOYED").isNull(),
        "sentinel_rows": F.col("DAYS_EMPLOYED_ANOMALY") == 1,
        "term_nulls": F.col("CREDIT_TERM_MONTHS").isNull(),
        "per_capita_nulls": F.col("INCOME_PER_FAMILY_MEMBER").isNull()})


# ---------------------------------------------------------------------------
# Keyed statistics
# ---------------------------------------------------------------------------

@register("rate_by_income_type", with_sql(APPLICATION_SQL) + """
SELECT NAME_INCOME_TYPE AS categoria, round_even(avg(TARGET), 6) AS taxa, count(TARGET) AS n,
       round_even((SELECT avg(TARGET) FROM application), 6) AS media_geral
FROM application WHERE NAME_INCOME_TYPE IS NOT NULL GROUP BY NAME_INCOME_TYPE""")
def q_rate_by_income_type(spark, sf_dir):
    r = prof.rate_by_category(roles.application(spark, sf_dir), "NAME_INCOME_TYPE")
    return r.select("categoria", r6("taxa").alias("taxa"), "n",
                    r6("media_geral").alias("media_geral"))


_MEDIAN_COLS = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "DAYS_BIRTH"]


@register("class_medians", with_sql(APPLICATION_SQL) + "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column,
  round_even(median({c}) FILTER (WHERE TARGET = 0), 4) AS median_0,
  round_even(median({c}) FILTER (WHERE TARGET = 1), 4) AS median_1
FROM application""" for c in _MEDIAN_COLS))
def q_class_medians(spark, sf_dir):
    m = prof.class_medians(roles.application(spark, sf_dir), _MEDIAN_COLS)
    return m.select("column", r4("median_0").alias("median_0"), r4("median_1").alias("median_1"))


@register("rate_by_loan_count_bin", ENRICHED_WITH + """
, b AS (
  SELECT CASE WHEN bureau_loan_count > 0 AND bureau_loan_count <= 1 THEN '0-1x'
              WHEN bureau_loan_count > 1 AND bureau_loan_count <= 2 THEN '1-2x'
              WHEN bureau_loan_count > 2 AND bureau_loan_count <= 4 THEN '2-4x'
              WHEN bureau_loan_count > 4 AND bureau_loan_count <= 8 THEN '4-8x'
              WHEN bureau_loan_count > 8 AND bureau_loan_count <= 100 THEN '>8x' END AS bin,
         CASE WHEN bureau_loan_count > 0 AND bureau_loan_count <= 1 THEN 0
              WHEN bureau_loan_count > 1 AND bureau_loan_count <= 2 THEN 1
              WHEN bureau_loan_count > 2 AND bureau_loan_count <= 4 THEN 2
              WHEN bureau_loan_count > 4 AND bureau_loan_count <= 8 THEN 3
              WHEN bureau_loan_count > 8 AND bureau_loan_count <= 100 THEN 4 END AS bin_index,
         TARGET FROM enriched)
SELECT bin, bin_index, round_even(avg(TARGET) * 100, 4) AS taxa_pct, count(TARGET) AS n
FROM b WHERE bin IS NOT NULL GROUP BY bin, bin_index ORDER BY bin_index""")
def q_rate_by_loan_count_bin(spark, sf_dir):
    from lendspark.functions.scalar import RATIO_BIN_EDGES, RATIO_BIN_LABELS
    r = prof.rate_by_bin(enriched(spark, sf_dir), "bureau_loan_count", RATIO_BIN_EDGES, RATIO_BIN_LABELS)
    return r.select("bin", "bin_index", r4("taxa_pct").alias("taxa_pct"), "n")


@register("rate_by_segment_priority", with_sql(APPLICATION_SQL) + """
SELECT NAME_CONTRACT_TYPE AS segment, count(*) AS n,
       CAST(coalesce(sum(TARGET), 0) AS BIGINT) AS positives,
       round_even(avg(TARGET), 4) AS rate
FROM application GROUP BY NAME_CONTRACT_TYPE ORDER BY segment""")
def q_rate_by_segment_priority(spark, sf_dir):
    return prof.rate_by_segment(roles.application(spark, sf_dir), "NAME_CONTRACT_TYPE")


@register("value_counts_event_type", """
SELECT event_type AS value, count(*) AS count,
       round_even(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS proportion
FROM events WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count DESC, value""")
def q_value_counts_event_type(spark, sf_dir):
    v = prof.value_counts(roles.table(spark, sf_dir, "events"), "event_type")
    return v.select("value", "count", r6("proportion").alias("proportion"))


@register("contingency_quality_toxic", """
SELECT quality AS row_value, toxic AS col_value, count(*) AS n
FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality, toxic""")
def q_contingency_quality_toxic(spark, sf_dir):
    return prof.contingency(roles.table(spark, sf_dir, "labels"), "quality", "toxic")


@register("upper_trim_p99_totalprice", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)""")
def q_upper_trim_p99_totalprice(spark, sf_dir):
    o = roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return prof.upper_trim(o, "o_totalprice", 99.0)


@register("distinct_counts_lineitem", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS coluna, count(DISTINCT {c}) AS n_unicos FROM lineitem"
    for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_quantity"]))
def q_distinct_counts_lineitem(spark, sf_dir):
    li = roles.table(spark, sf_dir, "lineitem")
    return prof.distinct_counts(li, ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag",
                                     "l_shipdate", "l_quantity"])


@register("sql_report_application", with_sql(APPLICATION_SQL) + """
SELECT NAME_INCOME_TYPE AS segment, count(*) AS n,
       round_even(CAST(avg(AMT_CREDIT) AS DOUBLE), 2) AS avg_credit,
       round_even(CAST(stddev_samp(AMT_CREDIT) AS DOUBLE), 2) AS std_credit,
       round_even(CAST(avg(TARGET) * 100 AS DOUBLE), 2) AS default_pct
FROM application GROUP BY NAME_INCOME_TYPE""")
def q_sql_report_application(spark, sf_dir):
    """A SQL report over a registered view (Catalyst plans the
    SQL text exactly like the DataFrame API)."""
    from lendspark.sources.io import sql_scan
    roles.application(spark, sf_dir).createOrReplaceTempView("application_view")
    rep = sql_scan(spark, """
        SELECT NAME_INCOME_TYPE AS segment, COUNT(*) AS n,
               AVG(AMT_CREDIT) AS avg_credit, STDDEV(AMT_CREDIT) AS std_credit,
               AVG(TARGET) * 100 AS default_pct
        FROM application_view GROUP BY NAME_INCOME_TYPE""")
    return rep.select("segment", "n", r2("avg_credit").alias("avg_credit"),
                      r2("std_credit").alias("std_credit"), r2("default_pct").alias("default_pct"))


def queries() -> dict[str, Query]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)


def _load_all() -> None:
    """Import the modules that register further queries."""
    from lendspark.plans import catalog_checks, catalog_jobs, catalog_ml, catalog_stats  # noqa: F401
