"""Spearman in slices of the value order."""

import numpy as np
import pandas as pd
import pytest

from lendspark.operators import assoc

NAN = float("nan")


@pytest.mark.parametrize("size", [500_000, 7])
@pytest.mark.parametrize("labels", [2, 1000])
def test_spearman_of_ties_holes_and_any_label(spark, monkeypatch, size, labels):
    monkeypatch.setattr(assoc, "SLICE_VALUES", size)
    rng = np.random.default_rng(11)
    n = 300
    y = rng.integers(0, labels, n).astype(float)
    data = {"few": rng.integers(0, 3, n) + 0.0, "many": rng.normal(size=n) + y, "same": np.ones(n),
            "holes": np.where(rng.random(n) < 0.4, NAN, rng.integers(-9, 9, n) - y), "TARGET": y}
    data["TARGET"][:5] = NAN
    frame = pd.DataFrame(data)
    rows = [tuple(None if i % 2 and v != v else float(v) for v in r) for i, r in enumerate(frame.itertuples(index=False))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame))
    got = {r["coluna"]: r["correlacao"] for r in assoc.correlation_with_target(df, "spearman").collect()}
    want = {}
    for c in ("few", "many", "holes"):
        pairs = frame[[c, "TARGET"]].dropna().rank()
        want[c] = np.corrcoef(pairs[c], pairs["TARGET"])[0, 1]
    assert got == pytest.approx(want, abs=1e-12)        # a constant column has no correlation


def test_spearman_moments_of_a_slice_add_up(spark):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"column": ["a", "b", "a"], "value": [2.0, 5.0, 1.0], "n": [1, 4, 2],
                                        "sy": [0.5, 3.0, -1.0]})
    got = [b.to_pylist()[0] for b in assoc._slice_moments(iter([batch.slice(0, 2), batch.slice(2)]))]
    assert got == [{"column": "a", "low": 1.0, "k": 3.0, "sy": -0.5, "dd": 1.5, "dy": 1.0},
                   {"column": "b", "low": 5.0, "k": 4.0, "sy": 3.0, "dd": 0.0, "dy": 0.0}]
