"""Registered preprocessing, model, scoring, streaming and chart-data queries.

Deterministic outputs (the fitted preprocessing matrix, fold / split sizes,
validation errors, chart tables) carry DuckDB oracle SQL; model-dependent ones
(CV metrics, scores, clusters, anomaly flags, PCA) are rows-only.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import functions as F

from lendspark.operators import charts, models as mdl, prep, scoring, segment as seg
from lendspark.operators import evaluate as ev
from lendspark.operators import profile as prof
from lendspark.functions import scalar
from lendspark.plans.catalog import ORACLE, enriched, r4, r6, register
from lendspark.sources import roles
from lendspark.sources.roles import APPLICATION_SQL, SCORES_SQL, with_sql
from lendspark.session import cut_lineage, cut_spread, ensure_checkpoint_dir, shared_path
from lendspark.sources import io

NUM = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "DAYS_BIRTH", "DAYS_EMPLOYED",
       "CNT_FAM_MEMBERS", "CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "CREDIT_TERM_MONTHS",
       "INCOME_PER_FAMILY_MEMBER", "AGE_YEARS", "EMPLOYED_YEARS", "EMPLOYED_TO_AGE_RATIO"]
CAT = ["NAME_CONTRACT_TYPE", "NAME_INCOME_TYPE", "ORGANIZATION_TYPE"]
# Category domains of the driver tables (TPC-H-like generator), sorted like
# StringIndexer(alphabetAsc): used only to write the oracle SQL.
LEVELS = {
    "NAME_CONTRACT_TYPE": sorted(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
    "NAME_INCOME_TYPE": sorted(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
    "ORGANIZATION_TYPE": sorted(f"NATION_{i}" for i in range(25)),
}

_DERIVED_SQL = """
, cleaned AS (
  SELECT *, CAST(CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END AS DOUBLE) AS DE
  FROM application),
derived AS (
  SELECT SK_ID_CURR, TARGET, AMT_CREDIT, AMT_INCOME_TOTAL, AMT_ANNUITY, CAST(DAYS_BIRTH AS DOUBLE) AS DAYS_BIRTH,
    DE AS DAYS_EMPLOYED, CNT_FAM_MEMBERS, NAME_CONTRACT_TYPE, NAME_INCOME_TYPE, ORGANIZATION_TYPE,
    AMT_CREDIT / nullif(AMT_INCOME_TOTAL, 0) AS CREDIT_INCOME_RATIO,
    AMT_ANNUITY / nullif(AMT_INCOME_TOTAL, 0) AS ANNUITY_INCOME_RATIO,
    AMT_CREDIT / nullif(AMT_ANNUITY, 0) AS CREDIT_TERM_MONTHS,
    AMT_INCOME_TOTAL / nullif(CNT_FAM_MEMBERS, 0) AS INCOME_PER_FAMILY_MEMBER,
    DAYS_BIRTH / -365.25 AS AGE_YEARS,
    DE / -365.25 AS EMPLOYED_YEARS,
    (DE / -365.25) / nullif(DAYS_BIRTH / -365.25, 0) AS EMPLOYED_TO_AGE_RATIO
  FROM cleaned)"""


def _preprocess_sql() -> str:
    meds = ", ".join(f"median({c}) AS m_{c}" for c in NUM)
    stats = ", ".join(f"avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS s_{c}"
                      for c in NUM)
    nums = ",\n  ".join(
        f"round_even((coalesce({c}, m_{c}) - a_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1 ELSE s_{c} END, 6)"
        f" AS {c}" for c in NUM)
    cats = ",\n  ".join(f"CASE WHEN {c} = '{lv}' THEN 1.0 ELSE 0.0 END AS \"{c}_{lv}\""
                        for c in CAT for lv in LEVELS[c])
    return with_sql(APPLICATION_SQL) + _DERIVED_SQL + f"""
, med AS (SELECT {meds} FROM derived),
st AS (SELECT {stats} FROM derived, med)
SELECT SK_ID_CURR, TARGET,
  {nums},
  {cats}
FROM derived, med, st"""


@register("preprocess_application", _preprocess_sql())
def q_preprocess_application(spark, sf_dir):
    app = roles.application(spark, sf_dir)
    model = prep.build_preprocessor(NUM, CAT).fit(app)
    pf = prep.processed_frame(model, app)
    return pf.select("SK_ID_CURR", "TARGET", *[r6(c).alias(c) for c in NUM],
                     *[c for c in pf.columns if c not in NUM and c not in ("SK_ID_CURR", "TARGET")])


@register("stratified_fold_sizes", with_sql(APPLICATION_SQL) + """
, cc AS (SELECT TARGET, count(*) AS n FROM application GROUP BY TARGET),
folds AS (SELECT range AS fold FROM range(5))
SELECT TARGET, CAST(fold AS INTEGER) AS fold, CAST((n - fold + 4) // 5 AS BIGINT) AS n
FROM cc, folds WHERE (n - fold + 4) // 5 > 0""")
def q_stratified_fold_sizes(spark, sf_dir):
    f = prep.stratified_folds(roles.application(spark, sf_dir), "TARGET", "SK_ID_CURR", k=5)
    return f.groupBy("TARGET", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("stratified_split_sizes", with_sql(APPLICATION_SQL) + """
, cc AS (SELECT TARGET, count(*) AS n FROM application GROUP BY TARGET)
SELECT TARGET, 'test' AS split, CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS n FROM cc
UNION ALL
SELECT TARGET, 'train' AS split, CAST(n - floor(n * 0.2 + 0.5) AS BIGINT) AS n FROM cc""")
def q_stratified_split_sizes(spark, sf_dir):
    s = prep.stratified_split(roles.application(spark, sf_dir), "TARGET", "SK_ID_CURR", 0.2)
    return s.groupBy("TARGET", "split").agg(F.count(F.lit(1)).alias("n"))


def _order_key_sql(c: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({c} AS VARCHAR) || ':{prep.RANDOM_STATE}'), 1, 15) AS BIGINT)"


_RANKED_SQL = with_sql(APPLICATION_SQL) + f""", r AS (
  SELECT SK_ID_CURR, TARGET, row_number() OVER (PARTITION BY TARGET ORDER BY {_order_key_sql('SK_ID_CURR')}) - 1 AS rk,
         count(*) OVER (PARTITION BY TARGET) AS n FROM application)
"""


@register("stratified_fold_members", _RANKED_SQL + """
SELECT SK_ID_CURR, TARGET, CAST(rk % 5 AS INTEGER) AS fold FROM r""")
def q_stratified_fold_members(spark, sf_dir):
    """The fold of every application."""
    app = roles.application(spark, sf_dir).select("SK_ID_CURR", "TARGET")
    return prep.stratified_folds(app, "TARGET", "SK_ID_CURR", k=5)


@register("stratified_split_members", _RANKED_SQL + """
SELECT SK_ID_CURR, TARGET, CASE WHEN rk < floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""")
def q_stratified_split_members(spark, sf_dir):
    """The side of every application."""
    app = roles.application(spark, sf_dir).select("SK_ID_CURR", "TARGET")
    return prep.stratified_split(app, "TARGET", "SK_ID_CURR", 0.2)


@register("sample_orders", f"""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY {_order_key_sql('o_orderkey')}, o_orderkey LIMIT 1000""")
def q_sample_orders(spark, sf_dir):
    o = roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return prep.sample_rows(o, 1000, "o_orderkey")


_SCORING_FIELDS = [
    ("AMT_CREDIT", None, True, ("gt", 0)), ("AMT_ANNUITY", None, False, ("gt", 0)),
    ("AMT_INCOME_TOTAL", None, True, ("gt", 0)), ("DAYS_BIRTH", None, True, ("lt", 0)),
    ("DAYS_EMPLOYED", None, True, None), ("CNT_FAM_MEMBERS", None, False, ("ge", 1)),
]


@register("validation_errors", with_sql(APPLICATION_SQL) + """
, e AS (
  SELECT SK_ID_CURR, concat_ws('; ',
    CASE WHEN AMT_CREDIT IS NULL THEN 'AMT_CREDIT: required' END,
    CASE WHEN AMT_CREDIT <= 0 THEN 'AMT_CREDIT: must be > 0' END,
    CASE WHEN AMT_ANNUITY <= 0 THEN 'AMT_ANNUITY: must be > 0' END,
    CASE WHEN AMT_INCOME_TOTAL IS NULL THEN 'AMT_INCOME_TOTAL: required' END,
    CASE WHEN AMT_INCOME_TOTAL <= 0 THEN 'AMT_INCOME_TOTAL: must be > 0' END,
    CASE WHEN DAYS_BIRTH IS NULL THEN 'DAYS_BIRTH: required' END,
    CASE WHEN DAYS_BIRTH >= 0 THEN 'DAYS_BIRTH: must be < 0' END,
    CASE WHEN DAYS_EMPLOYED IS NULL THEN 'DAYS_EMPLOYED: required' END,
    CASE WHEN CNT_FAM_MEMBERS < 1 THEN 'CNT_FAM_MEMBERS: must be >= 1' END) AS errors
  FROM application)
SELECT SK_ID_CURR, errors FROM e WHERE errors <> ''""")
def q_validation_errors(spark, sf_dir):
    from lendspark.sources.schemas import validate
    _, rejected = validate(roles.application(spark, sf_dir), _SCORING_FIELDS)
    return rejected.select("SK_ID_CURR", F.array_join("errors", "; ").alias("errors"))


@register("cross_validation_logistic")
def q_cross_validation_logistic(spark, sf_dir):
    app = roles.application(spark, sf_dir)
    _, summary = mdl.cross_validate(app, prep.build_preprocessor(NUM, CAT), "logistic_regression",
                                    k=5)
    return summary


@register("score_applications")
def q_score_applications(spark, sf_dir):
    app = roles.application(spark, sf_dir)
    model = mdl.fit_final(app, prep.build_preprocessor(NUM, CAT))
    return scoring.score_all(model, app, fields=_SCORING_FIELDS)


_SCORING_STATUS_SQL = ORACLE["validation_errors"].rsplit("SELECT SK_ID_CURR, errors", 1)[0] + """
SELECT SK_ID_CURR, CASE WHEN errors = '' THEN 'scored' ELSE 'rejected' END AS status, errors,
       true AS consistent FROM e"""


def _consistent(scored):
    """Status, errors, and whether probability, decision and band (on the rounded
    probability, so off the edges) agree; a rejected row has none of them."""
    p = F.col("probability_default")
    edge = F.lit(False)
    for x in (0.2, 0.4, 0.5, 0.6, 0.8):
        edge = edge | (F.abs(p - F.lit(x)) < 1e-4)
    agree = edge | ((F.col("decision") == scalar.decision(p)) & (F.col("score_band") == scalar.score_band(p)))
    return scored.select("SK_ID_CURR", "status", "errors", F.when(
        F.col("status") == scoring.SCORED, p.between(0, 1) & agree)
        .otherwise(p.isNull() & F.col("decision").isNull() & F.col("score_band").isNull()).alias("consistent"))


@register("scoring_status", _SCORING_STATUS_SQL)
def q_scoring_status(spark, sf_dir):
    """One row per application, scored or rejected."""
    return _consistent(q_score_applications(spark, sf_dir))


@register("stream_scoring_status", _SCORING_STATUS_SQL)
def q_stream_scoring_status(spark, sf_dir):
    """The same of the stream."""
    return _consistent(q_stream_scoring_application(spark, sf_dir))


@register("batch_total_by_status", ORACLE["validation_errors"].rsplit("SELECT SK_ID_CURR, errors", 1)[0] + """
SELECT CASE WHEN errors = '' THEN 'scored' ELSE 'rejected' END AS status, count(*) AS total
FROM e GROUP BY 1""")
def q_batch_total_by_status(spark, sf_dir):
    """Totals of a batch response."""
    scored = q_score_applications(spark, sf_dir)
    parts = [scoring.batch_total(scored.where(F.col("status") == s)).select(F.lit(s).alias("status"), "total")
             for s in (scoring.SCORED, scoring.REJECTED)]
    return parts[0].unionByName(parts[1]).where("total > 0")


@register("score_bands", with_sql(SCORES_SQL) + """
SELECT SK_ID_CURR, CASE TARGET WHEN 0 THEN 'Adimplente' WHEN 1 THEN 'Inadimplente' END AS classe,
       CASE WHEN score < 0.2 THEN 'A' WHEN score < 0.4 THEN 'B' WHEN score < 0.6 THEN 'C'
            WHEN score < 0.8 THEN 'D' ELSE 'E' END AS score_band,
       CASE WHEN score >= 0.5 THEN '""" + scalar.DECISION_DENIED + """' ELSE '""" + scalar.DECISION_APPROVED + """' END AS decision
FROM scores""")
def q_score_bands(spark, sf_dir):
    """I8 band, I10 decision, B18 label map over the deterministic scores."""
    s = roles.scores(spark, sf_dir)
    return s.select("SK_ID_CURR", scalar.label_map("TARGET", {0: "Adimplente", 1: "Inadimplente"}).alias("classe"),
                    scalar.score_band("score").alias("score_band"), scalar.decision("score").alias("decision"))


@register("stream_scoring_application")
def q_stream_scoring_application(spark, sf_dir):
    """The application table lands as files; a stream scores them."""
    from lendspark.streaming.scoring_stream import read_scored, start_scoring_stream
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    app = roles.application(spark, sf_dir)
    model = mdl.fit_final(app, prep.build_preprocessor(NUM, CAT))
    app.write.parquet(f"{base}/in")
    q = start_scoring_stream(spark, model, f"{base}/in", f"{base}/out", schema=app.schema,
                             checkpoint_dir=f"{base}/ckpt", max_files_per_trigger=2,
                             fields=_SCORING_FIELDS)
    q.awaitTermination()
    return read_scored(spark, f"{base}/out").drop("batch_id")


def _embedding_vectors(spark, sf_dir):
    return seg.to_vector(roles.table(spark, sf_dir, "embeddings"), "embedding")


@register("kmeans_segments")
def q_kmeans_segments(spark, sf_dir):
    clustered, _ = seg.segment_customers(_embedding_vectors(spark, sf_dir))
    return prof.rate_by_segment(clustered.withColumn("TARGET", (F.col("label") == 0).cast("int")), "cluster")


@register("isolation_forest_lineitem")
def q_isolation_forest_lineitem(spark, sf_dir):
    li = roles.table(spark, sf_dir, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    v = seg.to_vector(li.select("l_orderkey", "l_linenumber", "l_returnflag", *cols), cols)
    v = v.withColumn("_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    flagged = seg.detect_anomalies(v, id_col="_id")
    return prof.rate_by_segment(flagged.withColumn("TARGET", (F.col("l_returnflag") == "R").cast("int")),
                                "anomalia")


@register("pca_embeddings")
def q_pca_embeddings(spark, sf_dir):
    proj, ratios = seg.pca_2d(_embedding_vectors(spark, sf_dir))
    # explained-variance ratios are 2 numbers; the projection carries the rows
    return proj.select("vec_id", "label", r6("pc1").alias("pc1"), r6("pc2").alias("pc2")) \
               .withColumn("explained_variance_pc1", F.lit(ratios[0])) \
               .withColumn("explained_variance_pc2", F.lit(ratios[1]))


# ---------------------------------------------------------------------------
# Chart data
# ---------------------------------------------------------------------------

@register("chart_class_balance", with_sql(APPLICATION_SQL) + """
SELECT TARGET AS classe, count(*) AS count, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM application WHERE TARGET IS NOT NULL GROUP BY TARGET""")
def q_chart_class_balance(spark, sf_dir):
    c = charts.class_balance(roles.application(spark, sf_dir))
    return c.select("classe", "count", r6("pct").alias("pct"))


@register("chart_box_stats_credit", with_sql(APPLICATION_SQL) + """
, q AS (SELECT TARGET, quantile_cont(AMT_CREDIT, 0.25) AS q1, quantile_cont(AMT_CREDIT, 0.5) AS median,
               quantile_cont(AMT_CREDIT, 0.75) AS q3
        FROM application WHERE AMT_CREDIT IS NOT NULL AND TARGET IS NOT NULL GROUP BY TARGET),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.TARGET, round_even(q1, 4) AS q1, round_even(median, 4) AS median, round_even(q3, 4) AS q3,
       round_even(min(AMT_CREDIT) FILTER (WHERE AMT_CREDIT >= lo), 4) AS whisker_low,
       round_even(max(AMT_CREDIT) FILTER (WHERE AMT_CREDIT <= hi), 4) AS whisker_high,
       count(*) FILTER (WHERE AMT_CREDIT < lo OR AMT_CREDIT > hi) AS n_outliers
FROM application a JOIN f ON a.TARGET = f.TARGET WHERE AMT_CREDIT IS NOT NULL
GROUP BY f.TARGET, q1, median, q3""")
def q_chart_box_stats_credit(spark, sf_dir):
    b = charts.box_stats(roles.application(spark, sf_dir), "AMT_CREDIT")
    return b.select("TARGET", *[r4(c).alias(c) for c in ["q1", "median", "q3", "whisker_low", "whisker_high"]],
                    "n_outliers")


@register("chart_histogram_extendedprice", """
, r AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem),
b AS (SELECT CASE WHEN mx = mn THEN 1 ELSE CAST(least(floor((l_extendedprice - mn) / (mx - mn) * 50) + 1, 50) AS INTEGER) END AS bin,
             mn, mx FROM lineitem, r WHERE l_extendedprice IS NOT NULL)
SELECT bin, round_even(mn + (bin - 1) * ((mx - mn) / 50), 4) AS "left",
       round_even(mn + bin * ((mx - mn) / 50), 4) AS "right", count(*) AS count
FROM b GROUP BY bin, mn, mx""".replace("\n, r AS", "WITH r AS", 1))
def q_chart_histogram_extendedprice(spark, sf_dir):
    h = charts.histogram(roles.table(spark, sf_dir, "lineitem"), "l_extendedprice", 50)
    return h.select("bin", r4("left").alias("left"), r4("right").alias("right"), "count")


@register("chart_density_by_class", with_sql(APPLICATION_SQL) + """
, base AS (SELECT AMT_CREDIT AS x, TARGET FROM application WHERE AMT_CREDIT IS NOT NULL AND TARGET IS NOT NULL),
t AS (SELECT x, TARGET FROM base WHERE x <= (SELECT quantile_cont(x, 0.99) FROM base)),
stats AS (SELECT TARGET, stddev_samp(x) * pow(count(*), -0.2) AS h, count(*) AS n FROM t GROUP BY TARGET),
rng AS (SELECT min(x) AS mn, max(x) AS mx FROM t),
fine AS (SELECT TARGET, least(floor((x - mn) / ((mx - mn) / 1024)), 1023) AS b, count(*) AS c
         FROM t, rng GROUP BY 1, 2),
centre AS (SELECT TARGET, mn + (b + 0.5) * ((mx - mn) / 1024) AS xc, c FROM fine, rng),
g AS (SELECT mn + i * (mx - mn) / 199 AS x FROM range(200) r(i), rng)
SELECT TARGET, round_even(x, 6) AS x,
       round_even(sum(c * exp(-0.5 * pow((x - xc) / h, 2)) / (h * sqrt(2 * pi()))) / any_value(n) * 1e6, 6) AS density_e6
FROM centre JOIN stats USING (TARGET), g GROUP BY TARGET, x""")
def q_chart_density_by_class(spark, sf_dir):
    """M2; densities of amounts are tiny, so they are given in millionths."""
    d = charts.density_by_class(roles.application(spark, sf_dir), "AMT_CREDIT")
    return d.select("TARGET", r6("x").alias("x"), r6(F.col("density") * 1e6).alias("density_e6"))


@register("chart_violin_amounts", with_sql(APPLICATION_SQL) + """
, base AS (SELECT 'AMT_CREDIT' AS c, AMT_CREDIT AS x, TARGET FROM application
           WHERE AMT_CREDIT IS NOT NULL AND TARGET IS NOT NULL
           UNION ALL SELECT 'AMT_ANNUITY', AMT_ANNUITY, TARGET FROM application
           WHERE AMT_ANNUITY IS NOT NULL AND TARGET IS NOT NULL),
stats AS (SELECT c, TARGET, stddev_samp(x) * pow(count(*), -0.2) AS h, count(*) AS n,
                 quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3
          FROM base GROUP BY c, TARGET),
rng AS (SELECT c, min(x) AS mn, max(x) AS mx FROM base GROUP BY c),
fine AS (SELECT c, TARGET, least(floor((x - mn) / ((mx - mn) / 1024)), 1023) AS b, count(*) AS k
         FROM base JOIN rng USING (c) GROUP BY 1, 2, 3),
centre AS (SELECT c, TARGET, mn + (b + 0.5) * ((mx - mn) / 1024) AS xc, k FROM fine JOIN rng USING (c)),
g AS (SELECT c, mn + i * (mx - mn) / 49 AS x FROM range(50) r(i), rng)
SELECT c AS "column", TARGET, round_even(x, 6) AS x,
       round_even(sum(k * exp(-0.5 * pow((x - xc) / h, 2)) / (h * sqrt(2 * pi()))) / any_value(n) * 1e6, 6) AS density_e6,
       round_even(any_value(q1), 4) AS q1, round_even(any_value(median), 4) AS median, round_even(any_value(q3), 4) AS q3
FROM centre JOIN stats USING (c, TARGET) JOIN g USING (c) GROUP BY c, TARGET, x""")
def q_chart_violin_amounts(spark, sf_dir):
    """M5; densities in millionths, as in M2."""
    v = charts.violin_stats(roles.application(spark, sf_dir), ["AMT_CREDIT", "AMT_ANNUITY"], grid=50)
    return v.select("column", "TARGET", r6("x").alias("x"), r6(F.col("density") * 1e6).alias("density_e6"),
                    r4("q1").alias("q1"), r4("median").alias("median"), r4("q3").alias("q3"))


@register("chart_scatter_age_tenure", with_sql(APPLICATION_SQL) + _DERIVED_SQL + """
, r AS (SELECT min(AGE_YEARS) AS x0, max(AGE_YEARS) AS x1, min(EMPLOYED_YEARS) AS y0, max(EMPLOYED_YEARS) AS y1
        FROM derived),
b AS (SELECT CASE WHEN x1 = x0 THEN 1 ELSE CAST(least(floor((AGE_YEARS - x0) / (x1 - x0) * 50) + 1, 50) AS INTEGER) END AS x_bin,
             CASE WHEN y1 = y0 THEN 1 ELSE CAST(least(floor((EMPLOYED_YEARS - y0) / (y1 - y0) * 50) + 1, 50) AS INTEGER) END AS y_bin
      FROM derived, r WHERE AGE_YEARS IS NOT NULL AND EMPLOYED_YEARS IS NOT NULL)
SELECT x_bin, y_bin, count(*) AS count FROM b GROUP BY x_bin, y_bin""")
def q_chart_scatter_age_tenure(spark, sf_dir):
    from lendspark.operators.features import AnomalyHandler, DomainFeatureBuilder
    d = DomainFeatureBuilder().transform(AnomalyHandler().transform(roles.application(spark, sf_dir)))
    return charts.scatter_bins(d, "AGE_YEARS", "EMPLOYED_YEARS", 50)


@register("chart_top_null_columns", with_sql(APPLICATION_SQL) + """
, x AS (SELECT a.*, l.n_lines FROM application a LEFT JOIN
        (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) l ON a.SK_ID_CURR = l.l_orderkey),
np AS (
  SELECT 'n_lines' AS coluna, count(*) FILTER (WHERE n_lines IS NULL) AS n_nulos,
         round_even(count(*) FILTER (WHERE n_lines IS NULL) * 100.0 / count(*), 2) AS pct_nulos, 'bigint' AS dtype FROM x
  UNION ALL
  SELECT 'DAYS_EMPLOYED_CLEAN', count(*) FILTER (WHERE DAYS_EMPLOYED = 365243),
         round_even(count(*) FILTER (WHERE DAYS_EMPLOYED = 365243) * 100.0 / count(*), 2), 'double' FROM x)
SELECT * FROM np WHERE n_nulos > 0 ORDER BY pct_nulos DESC, coluna LIMIT 40""")
def q_chart_top_null_columns(spark, sf_dir):
    app = roles.application(spark, sf_dir)
    lines = roles.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    x = (app.join(lines, app.SK_ID_CURR == lines.l_orderkey, "left")
            .select("n_lines", F.when(F.col("DAYS_EMPLOYED") == 365243, F.lit(None))
                    .otherwise(F.col("DAYS_EMPLOYED")).cast("double").alias("DAYS_EMPLOYED_CLEAN")))
    return charts.top_null_columns(x, 40)


# ---------------------------------------------------------------------------
# Model comparison, search, MLP, persistence and runs (K3, L7-L11, L13, L15,
# L16, A12, A13, N4). The notebook starts these from the processed table
# (preprocessing fitted once, a pass-through pipeline in the searches); so do
# these queries. Model outputs are rows-only.
# ---------------------------------------------------------------------------

# Fixed values (the notebook's settings for these runs)
SEARCH_FOLDS = 3
SEARCH_C_RANGE = (1e-3, 10.0)          # C ~ loguniform(1e-3, 10)
NOTEBOOK_MLP_HIDDEN = (128, 64, 32)
NOTEBOOK_MLP_EPOCHS = 10
NOTEBOOK_MLP_BATCH = 512
SEARCH_TRIALS = 3            # one of each model: fixed work, whatever the machine and the data size


def _processed(spark, sf_dir):
    """Application rows through the fitted preprocessing pipeline (id, label,
    features vector), materialized once in the shared folder, in partitions of
    bounded size: every fit's tasks and cached blocks are those partitions."""
    app = cut_spread(roles.application(spark, sf_dir))
    pm = prep.build_preprocessor(NUM, CAT).fit(app)
    return cut_lineage(pm.transform(app).select("SK_ID_CURR", "TARGET", "features"))


def _holdout(spark, sf_dir):
    """B14 80/20 stratified split of the processed rows: (train, test)."""
    rows = _processed(spark, sf_dir)
    split = cut_spread(prep.stratified_split(rows, "TARGET", "SK_ID_CURR", 0.2), rows.count())
    return split.where(F.col("split") == "train"), split.where(F.col("split") == "test")


def _class_ratio(df) -> float:
    """n_neg / n_pos rounded to 2 (the notebook's ``scale_pos_weight``)."""
    return round(mdl.positive_weight(df, "TARGET"), 2)


def _compare_models(spark, sf_dir):
    train, test = _holdout(spark, sf_dir)
    spw = _class_ratio(train)
    scored = []
    for name in mdl.AVAILABLE_MODELS:
        tr = mdl.add_balanced_weights(train, "TARGET",
                                      scale_pos_weight=spw if name == "xgboost" else None)
        m = mdl.get_model(name).fit(tr)
        scored.append(mdl.with_probability(m.transform(test))
                      .select(F.lit(name).alias("model"), F.col("TARGET").alias("label"), "score"))
    allp = scored[0]
    for s in scored[1:]:
        allp = allp.unionByName(s)
    # every model's scores evaluated in one job, grouped by model
    return ev.evaluate(allp, "label", "score", groups=["model"])


@register("model_comparison_holdout")
def q_model_comparison_holdout(spark, sf_dir):
    """K3: the four classifiers (L8-L10, balanced weights L11; xgboost with
    scale_pos_weight) fitted on 80 %, K1 metrics on the held-out 20 %."""
    return _compare_models(spark, sf_dir).orderBy(F.col("auc_roc").desc(), "model")


@register("experiment_runs")
def q_experiment_runs(spark, sf_dir):
    """One run per compared model appended to a runs table in the shared
    folder, read back best-first on AUC."""
    runs_path = shared_path(spark, f"runs-{uuid.uuid4().hex}")
    for r in _compare_models(spark, sf_dir).collect():  # one row per model (4)
        d = r.asDict()
        io.log_run(spark, runs_path, "model_comparison", params={"model_name": d.pop("model")},
                   metrics=d)
    runs = io.search_runs(spark, runs_path, metric="auc_roc")
    return runs.select("source", F.element_at("params", "model_name").alias("model_name"),
                       "auc_roc", F.element_at("metrics", "ks_stat").alias("ks_stat"))


@register("random_search_logistic")
def q_random_search_logistic(spark, sf_dir):
    """20 seeded draws of C ~ loguniform(1e-3, 10), 3 stratified folds,
    exact AUC. Spark's L2 term is regParam * |w|^2 / 2 on the mean loss, so
    C maps to regParam = 1 / (C * n_train)."""
    data = _processed(spark, sf_dir)
    n_train = data.count() * (SEARCH_FOLDS - 1) / SEARCH_FOLDS
    lo, hi = 1.0 / (SEARCH_C_RANGE[1] * n_train), 1.0 / (SEARCH_C_RANGE[0] * n_train)
    best, auc, _ = mdl.random_search(data, prep.passthrough(), {"regParam": ("loguniform", lo, hi)},
                                     k=SEARCH_FOLDS, parallelism=4)
    reg = float(best["regParam"])
    return spark.createDataFrame(
        [(1.0 / (reg * n_train), reg, auc, mdl.SEARCH_DRAWS, SEARCH_FOLDS)],
        "best_C double, best_reg_param double, best_auc_mean double, n_draws int, cv_folds int")


@register("budgeted_model_search")
def q_budgeted_model_search(spark, sf_dir):
    """Candidates of three model families tried round-robin, a fixed number
    of them, on an 80/20 split; best by validation AUC."""
    spaces = {
        "logistic_regression": {"regParam": ("loguniform", 1e-6, 1e-1)},
        "lightgbm": {"maxIter": ("randint", 10, 60), "maxDepth": ("randint", 3, 8),
                     "stepSize": ("loguniform", 0.01, 0.3)},
        "random_forest": {"numTrees": [50, 100, 200], "maxDepth": ("randint", 3, 11)},
    }
    name, params, auc, _ = mdl.budgeted_search(_processed(spark, sf_dir), prep.passthrough(), spaces,
                                               time_budget_s=None, max_trials=SEARCH_TRIALS)
    return spark.createDataFrame([(name, json.dumps(params, sort_keys=True), float(auc))],
                                 "best_estimator string, best_config string, val_auc_roc double")


@register("mlp_holdout")
def q_mlp_holdout(spark, sf_dir):
    """L16 as the notebook runs it: hidden 128-64-32, 10 epochs, batch 512,
    positives weighted n_neg / n_pos (rounded to whole copies); validation
    AUC / KS on the held-out 20 % and the loss history's last value."""
    train, test = _holdout(spark, sf_dir)
    model, history = mdl.fit_mlp(train, prep.passthrough(), max_iter=NOTEBOOK_MLP_EPOCHS,
                                 hidden=NOTEBOOK_MLP_HIDDEN, block_size=NOTEBOOK_MLP_BATCH,
                                 pos_weight=round(_class_ratio(train)))
    scored = mdl.with_probability(model.transform(test)).select(F.col("TARGET").alias("label"), "score")
    m = ev.evaluate(scored, "label", "score")
    return m.select(F.lit(len(history)).alias("n_iterations"),
                    F.lit(float(history[-1]) if history else None).cast("double").alias("final_loss"),
                    F.col("auc_roc").alias("val_auc_roc"), F.col("ks_stat").alias("val_ks_stat"))


def _saved_model(spark, sf_dir):
    app = roles.application(spark, sf_dir)
    model = mdl.fit_final(app, prep.build_preprocessor(NUM, CAT))
    path = shared_path(spark, f"model-{uuid.uuid4().hex}")
    io.save_model(model, path)
    return app, path


@register("saved_model_scores")
def q_saved_model_scores(spark, sf_dir):
    """A12 + N1: fit, save to the shared folder, load back and score every
    application with the loaded pipeline."""
    app, path = _saved_model(spark, sf_dir)
    return scoring.score_all(io.load_model(path), app, fields=_SCORING_FIELDS)


# ---------------------------------------------------------------------------
# CSV / Parquet sources and sinks through the named-table loader
# ---------------------------------------------------------------------------

@register("csv_loader_roundtrip", with_sql(APPLICATION_SQL, roles.BUREAU_SQL) + """
, b AS (SELECT SK_ID_CURR, count(SK_ID_BUREAU) AS n FROM bureau GROUP BY SK_ID_CURR)
SELECT a.NAME_CONTRACT_TYPE AS NAME_CONTRACT_TYPE, CAST(count(*) AS BIGINT) AS n_applications,
       CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n_bureau_loans,
       round_even(avg(a.AMT_CREDIT), 4) AS mean_credit
FROM application a LEFT JOIN b USING (SK_ID_CURR)
GROUP BY a.NAME_CONTRACT_TYPE""")
def q_csv_loader_roundtrip(spark, sf_dir):
    """A7 sink, A1/A2 typed CSV load (explicit schema: one pass, no
    inference), A5 pruned read, A6 Parquet scan: the application and bureau
    roles are written as CSV into the shared folder, loaded by name, the
    bureau count joined on (C1/D1), and the result staged through Parquet."""
    base = shared_path(spark, f"raw-{uuid.uuid4().hex}")
    app, bureau = roles.application(spark, sf_dir), roles.bureau(spark, sf_dir)
    app.write.option("header", True).csv(f"{base}/application_train.csv")
    bureau.write.option("header", True).csv(f"{base}/bureau.csv")
    loader = io.CreditDataLoader(spark, base, schemas={"application_train.csv": app.schema,
                                                       "bureau.csv": bureau.schema})
    a = loader.load_application_train().select("SK_ID_CURR", "AMT_CREDIT", "NAME_CONTRACT_TYPE")
    b = (loader.load_bureau().select("SK_ID_CURR", "SK_ID_BUREAU")
         .groupBy("SK_ID_CURR").agg(F.count("SK_ID_BUREAU").alias("n")))
    out = (a.join(b, "SK_ID_CURR", "left").groupBy("NAME_CONTRACT_TYPE")
            .agg(F.count(F.lit(1)).alias("n_applications"),
                 F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_bureau_loans"),
                 r4(F.avg("AMT_CREDIT")).alias("mean_credit")))
    staged = io.write_parquet(out, f"{base}/report.parquet")
    return io.read_parquet(spark, staged)


# ---------------------------------------------------------------------------
# Table sink in a created schema, catalog columns, SQL scan
# ---------------------------------------------------------------------------

# Fixed values (the reference's schema and table names)
FEATURES_DB = "credit_score"
FEATURES_TABLE = "features"
_APP_TYPES = [("SK_ID_CURR", "bigint"), ("TARGET", "int"), ("AMT_CREDIT", "double"),
              ("AMT_INCOME_TOTAL", "double"), ("AMT_ANNUITY", "double"), ("DAYS_BIRTH", "bigint"),
              ("DAYS_EMPLOYED", "bigint"), ("CNT_FAM_MEMBERS", "double"),
              ("NAME_CONTRACT_TYPE", "string"), ("NAME_INCOME_TYPE", "string"),
              ("ORGANIZATION_TYPE", "string")]


@register("features_table_columns", with_sql(APPLICATION_SQL) + "\nUNION ALL\n".join(
    f"SELECT {i + 1} AS ordinal_position, '{c}' AS column_name, '{t}' AS data_type, "
    f"CAST(count({c}) AS BIGINT) AS n_non_null FROM application"
    for i, (c, t) in enumerate(_APP_TYPES)))
def q_features_table_columns(spark, sf_dir):
    """A9 schema, A8 replace-table sink (external, files in the shared
    folder), A11 columns in ordinal order from the catalog, A10 SQL scan
    counting each column's values in the stored table."""
    base = shared_path(spark, f"tables-{uuid.uuid4().hex}")
    full = io.write_table(roles.application(spark, sf_dir), FEATURES_TABLE, FEATURES_DB,
                          path=f"{base}/{FEATURES_TABLE}",
                          database_location=f"{base}/{FEATURES_DB}.db")
    cols = io.list_columns(spark, FEATURES_TABLE, FEATURES_DB)
    names = [r["column_name"] for r in cols.select("column_name").collect()]  # one per column
    counts = io.sql_scan(spark, "SELECT stack({n}, {pairs}) AS (column_name, n_non_null) FROM "
                         "(SELECT {aggs} FROM {t})".format(
                             n=len(names),
                             pairs=", ".join(f"'{c}', c{i}" for i, c in enumerate(names)),
                             aggs=", ".join(f"count(`{c}`) AS c{i}" for i, c in enumerate(names)),
                             t=full))
    return (cols.join(counts, "column_name")
                .select("ordinal_position", "column_name", "data_type", "n_non_null"))
