import corpus_pipeline
from llm_corpus import frame, rows  # noqa: F401

from lendspark.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, tmp_path, rows, labels, items):
    frame(spark, rows).select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_act_and_keep_columns(spark, tmp_path, rows):
    item = "this benchmark passage must never be found in training text of any kind"
    rows = rows + [(900, "before " + item + " after"), (901, "my token = abcdef0123456789 here it is")]
    rows += [(1000 + i, f"scumword{'s' if i % 2 else ''} number {i} is bad") for i in range(80)]
    rows += [(2000 + i, f"plain number {i} is good and kind to us") for i in range(80)]
    labels = [(i, None, 1) for i in range(1000, 1080)] + [(i, None, 0) for i in range(2000, 2080)]
    sf = tables(spark, tmp_path, rows, labels, [(1, item)])
    docs, left = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf), "test-stage")
        if name != "packing":
            assert docs.columns == COLUMNS
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not left["toxicity"] & set(range(1000, 1080)) and len(left["toxicity"] & set(range(2000, 2080))) == 80
    assert 10 in left["n-gram Jaccard join"] and not {11, 12, 13} & left["n-gram Jaccard join"]
    assert 900 in left["n-gram Jaccard join"] and 900 not in left["benchmark decontamination"]
    assert left["secret scans"] == left["benchmark decontamination"] == left["packing"]


def test_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, sf).collect() == []
