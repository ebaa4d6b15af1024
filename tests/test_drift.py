"""PSI properties and the reference's exact-value cases."""

from __future__ import annotations

import math
import random

from classcraft.operators import drift as D


def test_numeric_psi_against_itself_is_small(spark):
    df = spark.createDataFrame([(0.0,)] * 700 + [(1.0,)] * 200 + [(2.0,)] * 100, "x double")
    base = D.numeric_baseline(df, ["x"])
    psi = D.psi_from_edges(df, base).first()["psi"]
    assert 0.0 <= psi < 0.05


def test_shares_psi_alerts(spark):
    shares = spark.createDataFrame([("d", "A", 0.5), ("d", "B", 0.5)], "column string, level string, share double")
    recent = spark.createDataFrame([("A",)] * 950 + [("B",)] * 50, "d string")
    assert D.psi_from_shares(recent, shares).first()["psi"] > 0.25
    only_a = spark.createDataFrame([("d", "A", 1.0)], "column string, level string, share double")
    all_b = spark.createDataFrame([("B",)] * 100, "d string")
    psi = D.psi_from_shares(all_b, only_a).first()["psi"]
    assert math.isfinite(psi) and psi > 0.25


def test_psi_is_non_negative_on_random_samples(spark):
    rnd = random.Random(11)
    a = spark.createDataFrame([(rnd.gauss(0, 1), rnd.choice("xyz")) for _ in range(2000)], "v double, t string")
    b = spark.createDataFrame([(rnd.gauss(0.3, 1.2), rnd.choice("xyzw")) for _ in range(1500)], "v double, t string")
    assert D.psi_numeric(a, b, ["v"]).first()["psi"] >= 0
    assert D.psi_categorical(a, b, ["t"]).first()["psi"] >= 0


def test_report_status_and_guards(spark, records):
    from pyspark.sql import functions as F

    base = D.numeric_baseline(records, ["score", "rating"])
    recent = records.where(F.col("record_id") % 3 == 0).withColumn("score", F.col("score") * 0.4)
    rows = D.drift_report(recent, base, None).collect()
    assert rows[0]["column"] == "score" and rows[0]["status"] == "alert" and rows[0]["overall"] == "alert"
    assert rows[0]["psi"] >= rows[-1]["psi"]
    tiny = records.limit(10)
    assert D.drift_report(tiny, base, None).first()["overall"] == "insufficient_data"
    assert D.drift_report(recent, None, None).first()["overall"] == "unavailable"
