"""Commit logs, incremental history state, table replacement and malformed CSV rows."""

import pytest
from pyspark.sql import functions as F

from lendspark.sources import commits, io
from lendspark.streaming import history_state as H

BUREAU = "SK_ID_CURR long, SK_ID_BUREAU long, CREDIT_ACTIVE string, AMT_CREDIT_SUM double, DAYS_CREDIT int"
ROWS = [(1, 10, "Active", 5.0, -3), (1, 11, "Closed", None, -5), (2, 12, None, 7.0, None), (None, 13, "Active", 1.0, 1),
        (2, 14, "Active", 2.5, -1), (3, None, "Closed", None, None), (1, 15, "Active", 4.0, -10)]


def test_half_written_and_repeated_batches(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(io.DataLoadError):
        commits.read_committed(spark, out)
    assert commits.write_batch(spark.range(3), out, 0)
    spark.range(100).write.parquet(f"{out}/batch_id=1/attempt=abroken")          # a write that never ended
    assert commits.read_committed(spark, out).count() == 3
    assert not commits.write_batch(spark.range(50), out, 0)                      # the batch again
    assert not commits.commit(spark, out, 0, ["elsewhere"])
    assert commits.write_batch(spark.range(5), out, 1)
    got = commits.read_committed(spark, out)
    assert got.columns == ["id", "batch_id"] and got.count() == 8
    assert [c.batch_id for c in commits.committed(spark, out)] == [0, 1]


def state_of(spark, out):
    return {r.SK_ID_CURR: tuple(r)[1:] for r in H.read_aggregates(spark, "bureau", out).collect()}


def test_state_equals_batch_aggregate_through_compaction(spark, tmp_path, monkeypatch):
    from lendspark.operators.features import bureau_aggregates
    monkeypatch.setattr(H, "COMPACT", 3)
    out = str(tmp_path / "state")
    for k, row in enumerate(ROWS):
        assert H.add_batch(spark.createDataFrame([row], BUREAU), "bureau", out, k)
        assert not H.add_batch(spark.createDataFrame([row] * 5, BUREAU), "bureau", out, k)
        want = {r.SK_ID_CURR: tuple(r)[1:] for r in
                bureau_aggregates(spark.createDataFrame(ROWS[:k + 1], BUREAU)).collect()}
        assert state_of(spark, out) == want
    entries = commits.committed(spark, out)
    assert entries[0].replaces and len(entries) < 4


def test_stream_reads_only_new_files(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    df = spark.createDataFrame(ROWS, BUREAU)
    for k in range(3):
        df.where(F.pmod("SK_ID_BUREAU", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(inbox)
        H.start_history_stream(spark, "bureau", inbox, out, df.schema, checkpoint_dir=progress).awaitTermination()
    assert state_of(spark, out)[1] == (3, 2, 9.0, -6.0) and state_of(spark, out)[2] == (2, 1, 9.5, -1.0)
    assert len(commits.committed(spark, out)) == 3
    with pytest.raises(ValueError):
        H.start_history_stream(spark, "nothing", inbox, out, df.schema)


def test_failing_replace_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    full = io.write_table(spark.range(4), "swap_t", database="swap_db", path=path)
    with pytest.raises(Exception, match="stop here"):
        io.write_table(spark.range(9).withColumn("id", F.when(F.col("id") > 5, F.raise_error(F.lit("stop here")).cast("long"))
                                                 .otherwise(F.col("id"))), "swap_t", database="swap_db", path=path)
    assert spark.table(full).count() == 4
    io.write_table(spark.range(7), "swap_t", database="swap_db", path=path)
    assert spark.table(full).count() == 7
    io.write_table(spark.range(2).withColumn("b", F.lit("x")), "swap_t", database="swap_db", path=path)     # other columns
    assert spark.table(full).columns == ["id", "b"] and spark.table(full).count() == 2
    io.write_table(spark.range(0).withColumn("b", F.lit("x")), "swap_t", database="swap_db", path=path)
    assert spark.table(full).count() == 0
    import os
    assert sum(n.startswith("v-") for n in os.listdir(path)) == 2


def test_malformed_csv_rows(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("k,x,s\n1,2.5,a\n2,oops,b\n3,,c\n")
    (folder / "b.csv").write_text("k,x,s\n4,1.0\n5,1.0,d,extra\n6,NaN,e\n")
    schema = spark.createDataFrame([], "k long, x double, s string").schema
    good, bad = io.read_csv_quarantined(spark, str(folder), schema)
    assert sorted((r.k, r.x, r.s) for r in good.collect()) == [(1, 2.5, "a"), (3, None, "c"), (6, None, "e")]
    assert good.select("k").count() == 3
    found = sorted((r.file.rsplit("/", 1)[1], r.text) for r in bad.collect())
    assert found == [("a.csv", "2,oops,b"), ("b.csv", "4,1.0"), ("b.csv", "5,1.0,d,extra")]
    with pytest.raises(io.DataLoadError, match="3 malformed rows.*a.csv: 2,oops,b"):
        io.read_csv_quarantined(spark, str(folder), schema, strict=True)
    with pytest.raises(io.DataLoadError, match="not found"):
        io.read_csv_quarantined(spark, str(folder / "none.csv"), schema)
