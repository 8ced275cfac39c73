"""Role views: the driver's TPC-H-like tables seen as lending tables.

Each role has a DataFrame builder (what the library runs) and the equivalent
SQL text (used by the DuckDB oracle). Keep the two in step.

| role          | source                               |
| ------------- | ------------------------------------ |
| application   | orders x customer x nation, 1 row / o_orderkey |
| bureau        | lineitem, n rows / l_orderkey        |
| credit_card   | lineitem                             |
| installments  | lineitem x orders                    |
| part_sizes    | part, sentinel p_size = 50           |
| scores        | orders: o_totalprice / max, label F  |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendspark.functions.nulls import nans_to_nulls

EPOCH = "1970-01-01"
PART_SIZE_SENTINEL = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with the ingest rule: NaN counts as missing."""
    return nans_to_nulls(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def _days_since_epoch(c: str):
    return F.datediff(F.to_date(F.col(c)), F.lit(EPOCH).cast("date"))


def application(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    return j.select(
        F.col("o_orderkey").alias("SK_ID_CURR"),
        (F.col("o_orderstatus") == "F").cast("int").alias("TARGET"),
        F.col("o_totalprice").alias("AMT_CREDIT"),
        F.col("c_acctbal").alias("AMT_INCOME_TOTAL"),
        (F.col("o_totalprice") * F.col("c_nationkey") / F.lit(240.0)).alias("AMT_ANNUITY"),
        F.datediff(F.lit(EPOCH).cast("date"), F.to_date("o_orderdate")).cast("long").alias("DAYS_BIRTH"),
        F.when(F.col("c_acctbal") < 0, F.lit(365243))
         .otherwise(-F.floor(F.col("c_acctbal"))).cast("long").alias("DAYS_EMPLOYED"),
        F.col("n_regionkey").cast("double").alias("CNT_FAM_MEMBERS"),
        F.col("o_orderpriority").alias("NAME_CONTRACT_TYPE"),
        F.col("c_mktsegment").alias("NAME_INCOME_TYPE"),
        F.col("n_name").alias("ORGANIZATION_TYPE"),
    )


APPLICATION_SQL = """
application AS (
  SELECT o_orderkey AS SK_ID_CURR,
         CAST(o_orderstatus = 'F' AS INTEGER) AS TARGET,
         o_totalprice AS AMT_CREDIT,
         c_acctbal AS AMT_INCOME_TOTAL,
         o_totalprice * c_nationkey / 240.0 AS AMT_ANNUITY,
         CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1970-01-01') AS BIGINT) AS DAYS_BIRTH,
         CAST(CASE WHEN c_acctbal < 0 THEN 365243 ELSE -floor(c_acctbal) END AS BIGINT) AS DAYS_EMPLOYED,
         CAST(n_regionkey AS DOUBLE) AS CNT_FAM_MEMBERS,
         o_orderpriority AS NAME_CONTRACT_TYPE,
         c_mktsegment AS NAME_INCOME_TYPE,
         n_name AS ORGANIZATION_TYPE
  FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
)"""


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("SK_ID_CURR"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("SK_ID_BUREAU"),
        F.when(F.col("l_returnflag") == "R", F.lit("Active")).otherwise(F.lit("Closed")).alias("CREDIT_ACTIVE"),
        F.col("l_extendedprice").alias("AMT_CREDIT_SUM"),
        _days_since_epoch("l_shipdate").alias("DAYS_CREDIT"),
    )


BUREAU_SQL = """
bureau AS (
  SELECT l_orderkey AS SK_ID_CURR,
         l_orderkey * 8 + l_linenumber AS SK_ID_BUREAU,
         CASE WHEN l_returnflag = 'R' THEN 'Active' ELSE 'Closed' END AS CREDIT_ACTIVE,
         l_extendedprice AS AMT_CREDIT_SUM,
         CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS DAYS_CREDIT
  FROM lineitem
)"""


def credit_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("SK_ID_CURR"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("AMT_BALANCE"),
        F.col("l_tax").alias("AMT_CREDIT_LIMIT_ACTUAL"),
        F.col("l_quantity").alias("AMT_DRAWINGS_CURRENT"),
    )


CREDIT_CARD_SQL = """
credit_card AS (
  SELECT l_orderkey AS SK_ID_CURR,
         l_extendedprice * l_discount AS AMT_BALANCE,
         l_tax AS AMT_CREDIT_LIMIT_ACTUAL,
         l_quantity AS AMT_DRAWINGS_CURRENT
  FROM lineitem
)"""


def installments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("l_orderkey").alias("SK_ID_CURR"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("AMT_PAYMENT"),
        F.col("l_extendedprice").alias("AMT_INSTALMENT"),
        _days_since_epoch("l_shipdate").cast("double").alias("DAYS_ENTRY_PAYMENT"),
        (_days_since_epoch("o_orderdate") + 60).cast("double").alias("DAYS_INSTALMENT"),
    )


INSTALLMENTS_SQL = """
installments AS (
  SELECT l_orderkey AS SK_ID_CURR,
         l_extendedprice * (1 - l_discount) AS AMT_PAYMENT,
         l_extendedprice AS AMT_INSTALMENT,
         CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS DAYS_ENTRY_PAYMENT,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 60 AS DOUBLE) AS DAYS_INSTALMENT
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic score with a binary label: o_totalprice / max(o_totalprice)."""
    o = table(spark, sf_dir, "orders")
    mx = o.agg(F.max("o_totalprice").alias("_mx"))  # one row
    return (o.crossJoin(F.broadcast(mx))
             .select(F.col("o_orderkey").alias("SK_ID_CURR"),
                     (F.col("o_orderstatus") == "F").cast("int").alias("TARGET"),
                     (F.col("o_totalprice") / F.col("_mx")).alias("score"),
                     F.col("o_orderpriority").alias("segment")))


SCORES_SQL = """
scores AS (
  SELECT o_orderkey AS SK_ID_CURR,
         CAST(o_orderstatus = 'F' AS INTEGER) AS TARGET,
         o_totalprice / (SELECT max(o_totalprice) FROM orders) AS score,
         o_orderpriority AS segment
  FROM orders
)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
