"""M1–M16 against brute-force Python on seeded data; SC scoring invariants."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from classcraft.operators import metrics as M


def brute_auc(pairs):
    pos = [p for p, y in pairs if y == 1]
    neg = [p for p, y in pairs if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(7)
    pairs = []
    for _ in range(400):
        y = int(rnd.random() < 0.4)
        p = round(min(max(rnd.gauss(0.35 + 0.3 * y, 0.2), 0.0), 1.0), 2)  # rounding makes ties
        pairs.append((p, y))
    return pairs, spark.createDataFrame(pairs, "p double, y int")


def test_auc_matches_brute_force(scored):
    pairs, df = scored
    got = M.auc_from_curve(M.score_curve(df)).first()["roc_auc"]
    assert got == pytest.approx(brute_auc(pairs), abs=1e-12)


def test_average_precision_stepwise(scored):
    pairs, df = scored
    n_pos = sum(y for _, y in pairs)
    ap, prev_r = 0.0, 0.0
    for t in sorted({p for p, _ in pairs}, reverse=True):
        tp = sum(1 for p, y in pairs if p >= t and y == 1)
        fp = sum(1 for p, y in pairs if p >= t and y == 0)
        r = tp / n_pos
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    got = M.average_precision_from_curve(M.score_curve(df)).first()["average_precision"]
    assert got == pytest.approx(ap, abs=1e-12)


def test_threshold_metrics(scored):
    pairs, df = scored
    t = 0.5
    tp = sum(1 for p, y in pairs if p >= t and y == 1)
    fp = sum(1 for p, y in pairs if p >= t and y == 0)
    fn = sum(1 for p, y in pairs if p < t and y == 1)
    tn = len(pairs) - tp - fp - fn
    r = M.binary_threshold_metrics(df, t).first()
    assert r["accuracy"] == pytest.approx((tp + tn) / len(pairs))
    assert r["precision"] == pytest.approx(tp / (tp + fp))
    assert r["recall"] == pytest.approx(tp / (tp + fn))
    assert r["balanced_accuracy"] == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
    assert r["brier_score"] == pytest.approx(sum((p - y) ** 2 for p, y in pairs) / len(pairs))
    conf = {(c["actual"], c["predicted"]): c["n"] for c in M.confusion_binary(df, t).collect()}
    assert conf == {(1, 1): tp, (0, 1): fp, (1, 0): fn, (0, 0): tn}


def test_best_f1_and_youden(scored):
    pairs, df = scored
    n_pos = sum(y for _, y in pairs)
    n_neg = len(pairs) - n_pos
    best_f1, best_j = None, None
    for t in sorted({p for p, _ in pairs}):
        tp = sum(1 for p, y in pairs if p >= t and y == 1)
        fp = sum(1 for p, y in pairs if p >= t and y == 0)
        f1 = 2 * tp / (tp + fp + n_pos)
        j = tp / n_pos - fp / n_neg
        if best_f1 is None or f1 > best_f1[0]:
            best_f1 = (f1, t)  # ascending scan keeps the lowest on ties
        if best_j is None or j >= best_j[0]:
            best_j = (j, t)  # >= keeps the highest on ties
    curve = M.score_curve(df)
    assert M.best_f1_threshold(curve).first()[0] == best_f1[1]
    assert M.best_youden_threshold(curve).first()[0] == best_j[1]


def test_single_class_gives_no_auc_and_default_threshold(spark):
    df = spark.createDataFrame([(0.2, 1), (0.9, 1)], "p double, y int")
    curve = M.score_curve(df)
    assert M.auc_from_curve(curve).first()[0] is None
    assert M.best_f1_threshold(curve).first()[0] == 0.5


def test_renormalize(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([0.0, 0.0],)], "probs array<double>")
    rows = [r[0] for r in df.select(M.renormalize(F.col("probs"))).collect()]
    assert rows == [[0.25, 0.75], [0.5, 0.5]]


def test_roc_points_bounded(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.random(), int(rnd.random() < 0.5)) for _ in range(3000)], "p double, y int")
    pts = M.roc_points(M.score_curve(df)).collect()
    assert 2 <= len(pts) <= 200


def test_multiclass_metrics_macro(spark):
    labels = ["a", "b", "c"]
    rows = [("a", [0.8, 0.1, 0.1]), ("b", [0.1, 0.8, 0.1]), ("c", [0.6, 0.3, 0.1]), ("a", [0.2, 0.7, 0.1])]
    df = spark.createDataFrame(rows, "y string, probs array<double>")
    r = M.multiclass_metrics(df, labels).first().asDict()
    assert r["accuracy"] == pytest.approx(0.5)
