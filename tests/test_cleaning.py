"""Learned cleaning applied to other frames, roles, reconciliation."""

from __future__ import annotations

import pytest

from classcraft.operators.clean import CleanRule, apply_cleaning, fit_cleaning
from classcraft.operators.roles import drop_duplicate_rows, drop_missing_target, fill_defaults, reconcile


def clean(train, rules, other=None, columns=None):
    state = fit_cleaning(train, rules, columns)
    return state, apply_cleaning(other if other is not None else train, state).collect()


def test_median_fill_learned_on_train(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    later = spark.createDataFrame([(None,), (None,)], "x double")
    _, rows = clean(train, [CleanRule("x")], later)
    assert [r["x"] for r in rows] == [2.0, 2.0]


def test_constant_fill_default_zero(spark):
    train = spark.createDataFrame([(1.0,), (None,)], "x double")
    _, rows = clean(train, [CleanRule("x", impute="constant")])
    assert sorted(r["x"] for r in rows) == [0.0, 1.0]


def test_mean_and_most_frequent(spark):
    train = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (6.0, "b"), (None, None)], "x double, t string")
    state, rows = clean(train, [CleanRule("x", impute="mean"), CleanRule("t", impute="most_frequent")])
    assert state.fill == {"x": 3.0, "t": "b"}
    assert rows[3]["x"] == 3.0 and rows[3]["t"] == "b"


def test_most_frequent_ties_take_smallest(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "t string")
    state, _ = clean(train, [CleanRule("t", impute="most_frequent")])
    assert state.fill["t"] == "a"


def test_coerce_numeric_text(spark):
    train = spark.createDataFrame([("2,500",), ("12%",), ("  ",)], "x string")
    _, rows = clean(train, [CleanRule("x", coerce_numeric=True)])
    assert [r["x"] for r in rows] == [2500.0, 12.0, pytest.approx(1256.0)]


def test_missing_flag_taken_before_fill(spark):
    train = spark.createDataFrame([(5.0,), (None,)], "x double")
    _, rows = clean(train, [CleanRule("x")])
    assert [r["__missing__x"] for r in rows] == [0.0, 1.0]


def test_fold_rare_levels_and_unseen(spark):
    train = spark.createDataFrame([("A",)] * 90 + [("B",)] * 9 + [("C",)], "d string")
    state = fit_cleaning(train, [CleanRule("d", impute="most_frequent", rare_min_frequency=0.05)])
    later = spark.createDataFrame([("A",), ("B",), ("C",), ("Z",)], "d string")
    assert [r["d"] for r in apply_cleaning(later, state).collect()] == ["A", "B", "Other", "Other"]


def test_strip_and_lowercase(spark):
    train = spark.createDataFrame([(" Yes ",), ("NO",)], "t string")
    _, rows = clean(train, [CleanRule("t", strip_whitespace=True, lowercase=True, impute="most_frequent")])
    assert [r["t"] for r in rows] == ["yes", "no"]


def test_absent_column_is_filled_and_flagged(spark):
    train = spark.createDataFrame([(1.0, 9.0), (2.0, 9.0)], "a double, b double")
    state = fit_cleaning(train, [CleanRule("a"), CleanRule("b")])
    later = spark.createDataFrame([(3.0,)], "a double")
    row = apply_cleaning(later, state).first()
    assert row["b"] == 9.0 and row["__missing__b"] == 1.0


def test_clip_after_fill(spark):
    train = spark.createDataFrame([(-20.0,), (250.0,)], "x double")
    _, rows = clean(train, [CleanRule("x", clip_min=0, clip_max=100)])
    assert [r["x"] for r in rows] == [0.0, 100.0]


def test_residual_nulls(spark):
    train = spark.createDataFrame([(None, None)], "x double, t string")
    _, rows = clean(train, [CleanRule("x", impute="none"), CleanRule("t", impute="none")])
    assert rows[0]["x"] == 0.0 and rows[0]["t"] == "Other"


def test_drop_missing_target_and_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, y string")
    assert drop_missing_target(df, "y").count() == 2
    assert drop_duplicate_rows(df).count() == 2


def test_reconcile_reports_and_projects(spark):
    df = spark.createDataFrame([(1.0, "q", 7)], "a double, extra string, c int")
    out, report = reconcile(df, [("a", "double"), ("b", "string"), ("c", "int")])
    assert out.columns == ["a", "b", "c"]
    row = out.first()
    assert row["b"] is None and row["c"] == 7
    assert set(report["missing"]) == {"b"} and set(report["extra"]) == {"extra"}


def test_fill_defaults_only_where_missing(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, unknown string")
    out = fill_defaults(df, {"a": 5.0, "b": "CS"})
    assert out.columns == ["a", "b"]
    row = out.first()
    assert row["a"] == 1.0 and row["b"] == "CS"
