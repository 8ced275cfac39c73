"""Registered queries of jobs and their storage: incremental history state, malformed
CSV rows kept apart, table replacement, core tables by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendspark.operators import features as feat
from lendspark.plans.catalog import ORACLE, r2, r4, register
from lendspark.session import cut_lineage, shared_path
from lendspark.sources import io, roles
from lendspark.sources.roles import APPLICATION_SQL, BUREAU_SQL, CREDIT_CARD_SQL, with_sql
from lendspark.streaming import history_state

ARRIVALS = 3


def _arrive(spark: SparkSession, rows: DataFrame, table: str, base: str) -> DataFrame:
    """The table's rows arrive as files in three goes, with a run of the stream after each."""
    dealt = cut_lineage(rows.withColumn("_go", F.pmod(F.xxhash64(*rows.columns), F.lit(ARRIVALS))))
    inbox, state = f"{base}/{table}/in", f"{base}/{table}/state"
    for go in range(ARRIVALS):
        dealt.where(F.col("_go") == go).drop("_go").write.mode("append").parquet(inbox)
        history_state.start_history_stream(rows.sparkSession, table, inbox, state, rows.schema,
                                           checkpoint_dir=f"{base}/{table}/progress").awaitTermination()
    return history_state.read_aggregates(spark, table, state)


@register("history_state_three_arrivals", ORACLE["history_enrichment"])
def q_history_state_three_arrivals(spark, sf_dir):
    """N6 incremental: D1-D10 from state that three arrivals of every history table
    built, equal to the aggregates over all rows at once."""
    base = shared_path(spark, f"history-{uuid.uuid4().hex}")
    out = roles.application(spark, sf_dir).select("SK_ID_CURR", "TARGET")
    for table in history_state.PARTS:
        out = out.join(_arrive(spark, getattr(roles, table)(spark, sf_dir), table, base), "SK_ID_CURR", "left")
    return out.select(
        "SK_ID_CURR", "TARGET", "bureau_loan_count", "bureau_active_loans",
        r2("bureau_total_credit_sum").alias("bureau_total_credit_sum"),
        r4("bureau_mean_days_credit").alias("bureau_mean_days_credit"),
        r4("cc_utilization_mean").alias("cc_utilization_mean"), r2("cc_drawings_total").alias("cc_drawings_total"),
        "cc_months_with_balance", r4("install_payment_ratio_mean").alias("install_payment_ratio_mean"),
        r4("install_days_late_mean").alias("install_days_late_mean"), "install_late_count")


@register("csv_malformed_rows", """
SELECT CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' THEN 'quarantined' ELSE 'loaded' END AS fate,
       concat_ws(',', o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE CAST(o_custkey AS VARCHAR) END,
                 o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN 'one,more' END) AS line
FROM orders""")
def q_csv_malformed_rows(spark, sf_dir):
    """A1: orders as CSV lines, those of status P with a word for a number, the urgent ones
    with a field too many: these lines are kept apart, all others are loaded."""
    o = roles.table(spark, sf_dir, "orders")
    path = f"{shared_path(spark, f'raw-{uuid.uuid4().hex}')}/orders.csv"
    urgent = F.col("o_orderpriority") == "1-URGENT"
    fields = [F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "P", F.lit("unknown")).otherwise(
        F.col("o_custkey").cast("string")).alias("customer"), F.col("o_orderstatus").alias("status")]
    extra = [F.lit("one").alias("extra"), F.lit("more").alias("further")]
    for rows in (o.where(~urgent).select(*fields), o.where(urgent).select(*fields, *extra)):
        rows.write.mode("append").option("header", True).csv(path)
    schema = spark.createDataFrame([], "key long, customer long, status string").schema
    good, bad = io.read_csv_quarantined(spark, path, schema)
    return (good.select(F.lit("loaded").alias("fate"), F.concat_ws(",", "key", "customer", "status").alias("line"))
            .unionByName(bad.select(F.lit("quarantined").alias("fate"), F.col("text").alias("line"))))


@register("table_replaced_whole", with_sql(APPLICATION_SQL) + """
SELECT 'written' AS step, count(*) AS n, round_even(sum(AMT_CREDIT), 2) AS total FROM application
UNION ALL SELECT 'failed write', count(*), round_even(sum(AMT_CREDIT), 2) FROM application
UNION ALL SELECT 'replaced', count(*), round_even(sum(2 * AMT_CREDIT), 2) FROM application WHERE TARGET = 1""")
def q_table_replaced_whole(spark, sf_dir):
    """A replace that fails half way leaves the old rows, one that ends shows the new."""
    base, name = shared_path(spark, f"tables-{uuid.uuid4().hex}"), f"replaced_{uuid.uuid4().hex[:8]}"
    app = roles.application(spark, sf_dir)
    state = lambda step: cut_lineage(spark.table(full).agg(                                     # noqa: E731
        F.lit(step).alias("step"), F.count(F.lit(1)).alias("n"), r2(F.sum("AMT_CREDIT")).alias("total")))
    full = io.write_table(app, name, path=f"{base}/{name}")
    steps = [state("written")]
    fails = app.withColumn("AMT_CREDIT", F.when(F.col("TARGET") == 1, F.raise_error(F.lit("broken row")).cast("double"))
                           .otherwise(F.lit(0.0)))
    try:
        io.write_table(fails, name, path=f"{base}/{name}")
        raise AssertionError("the write did not fail")
    except Exception as exc:  # noqa: BLE001 - Spark wraps the row's error in several types
        if "broken row" not in str(exc):
            raise
    steps.append(state("failed write"))
    io.write_table(app.where("TARGET = 1").withColumn("AMT_CREDIT", 2 * F.col("AMT_CREDIT")), name, path=f"{base}/{name}")
    steps.append(state("replaced"))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


@register("core_tables_by_name", with_sql(APPLICATION_SQL, BUREAU_SQL, CREDIT_CARD_SQL) + """
SELECT 'application_train' AS name, count(*) AS n, count(DISTINCT SK_ID_CURR) AS applicants FROM application
UNION ALL SELECT 'bureau', count(*), count(DISTINCT SK_ID_CURR) FROM bureau
UNION ALL SELECT 'previous_application', count(*), count(DISTINCT SK_ID_CURR) FROM credit_card""")
def q_core_tables_by_name(spark, sf_dir):
    """The three core tables written as CSV and loaded as one dictionary, each
    reduced to the declared columns it has."""
    base = shared_path(spark, f"raw-{uuid.uuid4().hex}")
    source = {"application_train": roles.application(spark, sf_dir), "bureau": roles.bureau(spark, sf_dir),
              "previous_application": roles.credit_card(spark, sf_dir)}
    for name, df in source.items():
        df.write.option("header", True).csv(f"{base}/{name}.csv")
    loader = io.CreditDataLoader(spark, base, schemas={f"{n}.csv": df.schema for n, df in source.items()})
    parts = []
    for name, df in loader.load_all_core_tables().items():
        kept = feat.select_existing(df, ["SK_ID_CURR", "SK_ID_BUREAU", "NO_SUCH_COLUMN"])
        parts.append(kept.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"),
                              F.count_distinct("SK_ID_CURR").alias("applicants")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
