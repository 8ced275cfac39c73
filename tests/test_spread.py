"""Tables that models are fitted on: partitions of bounded size, whatever the files' row groups."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lendspark import session
from lendspark.plans import catalog_checks, catalog_ml

N = 3_000


@pytest.fixture
def tables(tmp_path, monkeypatch):
    """Orders in one row group, so that a scan of them is one task."""
    monkeypatch.setattr(session, "PART_ROWS", 500)
    rng = random.Random(5)
    write = lambda name, **c: pq.write_table(pa.table(c), tmp_path / f"{name}.parquet")
    write("orders", o_orderkey=list(range(N)), o_custkey=[rng.randrange(200) for _ in range(N)],
          o_orderstatus=[rng.choice("FOP") for _ in range(N)], o_totalprice=[rng.uniform(1e3, 4e5) for _ in range(N)],
          o_orderdate=[datetime(1992, 1, 1) + timedelta(rng.randrange(2000)) for _ in range(N)],
          o_orderpriority=[rng.choice(["1-URGENT", "2-HIGH", "5-LOW"]) for _ in range(N)])
    write("customer", c_custkey=list(range(200)), c_nationkey=[i % 5 for i in range(200)],
          c_acctbal=[rng.uniform(-999, 9999) for _ in range(200)],
          c_mktsegment=[rng.choice(["BUILDING", "MACHINERY"]) for _ in range(200)])
    write("nation", n_nationkey=list(range(5)), n_name=[f"NATION_{i}" for i in range(5)], n_regionkey=list(range(5)))
    return str(tmp_path)


def largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_rows_of_a_table_are_dealt_evenly_and_kept(spark, monkeypatch):
    df = spark.range(2_000).coalesce(1).select((F.col("id") % 1_999).alias("a b"), F.lit(None).cast("string").alias("c"))
    monkeypatch.setattr(session, "PART_ROWS", 4_000)
    assert session.cut_spread(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(session, "PART_ROWS", 200)
    assert session.cut_spread(df, 600).rdd.getNumPartitions() == 3
    got = session.cut_spread(df)
    assert largest(got) < 300
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in df.collect())
    assert session.cut_spread(df.limit(0)).count() == 0


def test_model_tables_have_partitions_of_bounded_size(spark, tables):
    train, test = catalog_ml._holdout(spark, tables)
    assert largest(catalog_ml._processed(spark, tables)) < 650
    assert largest(train) < 650 and train.count() + test.count() == N


def test_holdout_check_ranks_no_whole_table_in_one_task(spark, tables):
    q = catalog_checks.q_holdout_metrics_from_scores(spark, tables)
    assert "windowspecdefinition(score#" not in q._jdf.queryExecution().toString()
    r = q.first()
    assert r.n_scored == pytest.approx(N / 5, abs=2) and r.auc_follows and r.ks_follows and r.in_range
