import zlib
from collections import Counter, defaultdict
from llm_corpus import docs, frame, no_docs, rows  # noqa: F401


from lendspark.llm.sharding import balanced_shards


def check(got, rows):
    want = Counter((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    slots, load = defaultdict(list), Counter({s: 0 for s in range(16)})
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < 16 and r.grown_shard is None
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    for v in slots.values():
        assert sorted(v) == list(range(len(v)))
    return load


def test_awkward_rows(spark, docs, rows):
    check(balanced_shards(docs).collect(), rows)


def test_even_bytes_and_few_cut_groups(spark):
    rows = [(i, f"text {i} " + "x" * (i * 37 % 400)) for i in range(2000)]
    rows += [(10_000 + i, f"group {i // 4} " + "y" * (i // 4 * 53 % 300)) for i in range(800)]
    rows += [(50_000 + i, "hot copy " * 20) for i in range(1400)]        # a third of the rows
    got = balanced_shards(frame(spark, rows).repartition(4)).collect()
    load = check(got, rows)
    mean = sum(load.values()) / 16
    assert max(abs(v - mean) for v in load.values()) < 1000
    where = defaultdict(set)
    for r in got:
        if 10_000 <= r.doc_id < 50_000:
            where[r.text_crc32].add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) <= 16


def test_all_documents_linked(spark):
    """3,000 groups of all sizes and nothing else: only groups at a border are cut."""
    rows = [(i * 10 + k, f"group {i} " + "z" * (i * 131 % 900)) for i in range(3000) for k in range(2 + i % 7)]
    got = balanced_shards(frame(spark, rows).repartition(4)).collect()
    load = check(got, rows)
    mean = sum(load.values()) / 16
    assert max(abs(v - mean) for v in load.values()) < 2000
    where = defaultdict(set)
    for r in got:
        where[r.doc_id // 10].add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) < 50


def test_rows_of_a_null_id_and_hot_group_alone(spark):
    rows = [(None, "same text " * 5)] * 40 + [(i, "same text " * 5) for i in range(500)]
    load = check(balanced_shards(frame(spark, rows).repartition(3)).collect(), rows)
    mean = sum(load.values()) / 16
    assert max(abs(v - mean) for v in load.values()) <= 2 * 51


def test_empty(no_docs):
    assert balanced_shards(no_docs).collect() == []
