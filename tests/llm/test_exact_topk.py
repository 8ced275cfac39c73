import math
import random

from pyspark.sql import functions as F

import numpy as np
import pytest

from lendspark.llm import exact_topk


def brute(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 20 == 0}):
        qv = min(v for i, v in ok if i == q)
        s = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) if rng.random() < 0.6 else 0.0 for _ in range(8)]) for i in range(130)]
    rows += [(200, [0.5] * 8), (201, [0.5] * 8), (202, [0.5] * 8), (203, None), (204, [None] * 8),
             (205, [float("nan")] * 8), (206, [float("inf")] * 8), (207, []), (208, [1.0]), (220, []),
             (None, [0.1] * 8), (40, [9.0] * 8), (3, [0.3] * 8)]
    df = spark.createDataFrame([(i, v, i, 1) for i, v in rows],
                               "vec_id long, embedding array<float>, i long, score int").repartition(3)
    import numpy as np
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for block in (1000, 2):       # one block of queries, and several
        got = exact_topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, query_block=block).collect()
        assert sorted(map(tuple, got)) == brute(exact, 7)


def test_few_candidates_large_weights_and_empty(spark):
    df = spark.createDataFrame([(0, [1e6, 1e6]), (1, [1e6, -2.0])], "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 64_000_000 * (64_000_000 - 128))]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_topk.top_k(empty, F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("size", [1.2e6, 5e6, 1.6e7])
def test_large_components(spark, size):
    """1,200 vectors whose scores take up to the whole of a long, some beyond 2^53."""
    rng = random.Random(int(size))
    wide = 64 if size < 1e7 else 8
    rows = [(i, [rng.choice([-1, 1]) * size * rng.uniform(0.9, 1) for _ in range(wide)])
            for i in range(1, 1200)]
    rows += [(0, [size] * wide), (1200, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = exact_topk.top_k(df, F.col("vec_id") % 20 == 0, k=20)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)


def test_clear_order_beyond_the_old_limit(spark):
    df = spark.createDataFrame([(0, [5e6]), (1, [5e6]), (2, [6e6])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in exact_topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 122_880_000_000_000_000), (0, 2, 1, 102_400_000_000_000_000)]


def test_scores_beyond_a_long(spark):
    """Refused where they belong to the result, of no matter where they do not."""
    rows = [(0, [1e12, 0.0]), (1, [1e12, 1.0]), (2, [-1e12, 1.0]), (3, [1.0, 1e30]), (4, [2.0, 0.0])]
    low = spark.createDataFrame([r for r in rows if r[0] != 1], "vec_id long, embedding array<double>")
    got = exact_topk.top_k(low, F.col("vec_id") == 0, k=2).collect()
    assert [tuple(r) for r in got] == [(0, 1, 4, 64 * 10 ** 12 * 128), (0, 2, 3, 64 * 10 ** 12 * 64)]
    with pytest.raises(Exception, match="does not fit a long"):
        exact_topk.top_k(low, F.col("vec_id") == 0, k=3).collect()
    with pytest.raises(Exception, match="does not fit a long"):
        exact_topk.top_k(spark.createDataFrame(rows, low.schema), F.col("vec_id") == 0, k=1).collect()


def test_selection():
    rng = np.random.default_rng(1)
    score = rng.integers(-3, 4, (50, 30))
    s, at = exact_topk.select(score, 7)
    for r in range(50):
        want = sorted(range(30), key=lambda c: (-score[r, c], c))[:7]
        assert sorted(at[r].tolist()) == sorted(want) and (s[r] == score[r][at[r]]).all()
