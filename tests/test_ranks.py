from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from classcraft.operators import ranks


def test_quantiles_match_numpy_on_awkward_columns(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BINS", 64)
    rng = np.random.default_rng(1)
    data = {"normal": rng.normal(size=500), "tiny": rng.random(500) * 1e-300, "clustered": np.exp(rng.normal(size=500) * 40),
            "ties": rng.integers(0, 3, 500).astype(float), "one": np.full(500, 7.5), "wide": np.concatenate([[-1e308, 1e308], rng.normal(size=498)])}
    rows = [tuple(float(data[c][i]) for c in data) for i in range(500)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    points = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = ranks.quantiles(df, {c: F.col(c) for c in data}, points)
    for c in data:
        ordered = np.sort(data[c])
        for q, v in zip(points, got[c]):
            at = (len(ordered) - 1) * q
            low, high = ordered[int(at)], ordered[min(int(at) + 1, len(ordered) - 1)]
            assert np.isclose(v, low + (high - low) * (at - int(at)), rtol=1e-12)


def test_nothing_to_rank_and_modes(spark):
    df = spark.createDataFrame([(None, "b", 2), (None, "a", 10), (None, "a", 2), (None, "b", 10), (None, None, 3)], "x double, s string, n int")
    assert ranks.quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": None}
    assert ranks.medians(df, {"n": F.col("n")}) == {"n": 3.0}
    assert ranks.modes(df, {"s": (F.col("s"), False), "n": (F.col("n"), True), "x": (F.col("x"), True)}) == {"s": "a", "n": "2", "x": None}
