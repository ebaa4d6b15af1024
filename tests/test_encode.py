"""Weights, hash split/folds, class alignment and soft vote."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from classcraft.operators import encode as E


def test_balanced_and_custom_weights():
    w = E.class_weights({"a": 90, "b": 10}, "balanced")
    assert w["a"] * 90 == pytest.approx(w["b"] * 10)
    c = E.class_weights({"a": 1, "b": 1, "c": 1}, "custom", {"a": 2, "b": 5})
    assert c == {"a": 2.0, "b": 5.0, "c": 1.0}
    assert E.class_weights({"a": 90, "b": 10}, "custom", {}) == w
    assert set(E.class_weights({"a": 3, "b": 1}, "none").values()) == {1.0}


def _rare(spark):
    return spark.range(4000).select("id", F.when(F.col("id") % 500 == 3, "rare").when(F.col("id") % 3 == 0, "b").otherwise("a").alias("y"))


def test_split_is_stable_with_exact_quotas(spark):
    df = _rare(spark)
    counts = {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    out = df.withColumn("s", E.split_column(df, "id", "y", counts, 0.25))
    got = {r.y: r["count"] for r in out.where("s = 'test'").groupBy("y").count().collect()}
    assert counts["rare"] == 8 and got == {c: int(n * 0.25 + 0.5) for c, n in counts.items()}
    again = df.repartition(7).withColumn("s", E.split_column(df, "id", "y", counts, 0.25))
    assert out.exceptAll(again).count() == 0


def test_folds_hold_every_class_evenly(spark):
    k = E.fold_count(5, 3)
    assert k == 3 and E.fold_count(1, 100) == 2 and E.fold_count(50, 100) == 10
    df = _rare(spark)
    counts = {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    got = {}
    for r in df.select("y", E.fold_column(df, "id", "y", counts, k).alias("f")).groupBy("y", "f").count().collect():
        got.setdefault(r.y, {})[r.f] = r["count"]
    assert all(sorted(f) == [0, 1, 2] and max(f.values()) - min(f.values()) <= 1 for f in got.values())
    tiny = spark.createDataFrame([(1, "a"), (2, "a")], "id long, y string")
    assert {r.f for r in tiny.select(E.fold_column(tiny, "id", "y", {"a": 2}, 3).alias("f")).collect()} <= {0, 1, 2}


def test_align_and_soft_vote(spark):
    df = spark.createDataFrame([([0.0, 1.0], [1.0, 0.0])], "m1 array<double>, m2 array<double>")
    vote = df.select(E.soft_vote([F.col("m1"), F.col("m2")], [3.0, 1.0]).alias("v")).first()["v"]
    assert vote == pytest.approx([0.25, 0.75])
    plain = df.select(E.soft_vote([F.col("m1"), F.col("m2")], [0.0, 0.0]).alias("v")).first()["v"]
    assert plain == pytest.approx([0.5, 0.5])
    narrow = spark.createDataFrame([([1.0],)], "p array<double>")
    aligned = narrow.select(E.align_probs(F.col("p"), ["0"], ["1", "0"]).alias("a")).first()["a"]
    assert aligned == [0.0, 1.0]
    swapped = spark.createDataFrame([([0.2, 0.8],)], "p array<double>")
    assert swapped.select(E.align_probs(F.col("p"), ["1", "0"], ["0", "1"])).first()[0] == [0.8, 0.2]


def test_label_encoding_round_trip(spark):
    labels = ["approved", "rejected"]
    df = spark.createDataFrame([("rejected",), ("approved",)], "y string")
    idx = df.select(E.label_index(F.col("y"), labels).alias("i"))
    back = idx.select(E.index_label(F.col("i"), labels).alias("y"))
    assert [r["y"] for r in back.collect()] == ["rejected", "approved"]
