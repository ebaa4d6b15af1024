"""Exact values of the 24 operations, fitted-state reuse, plan validation."""

from __future__ import annotations

import math

import pytest

from classcraft.functions.features import ARITY, FeatureSpec, apply_features, fit_features
from classcraft.operators.synth import PlanRejected, validate_features


def run(df, spec, state=None):
    out = apply_features(df, [spec], state)
    return [r[spec.name] for r in out.orderBy(df.columns[0]).collect()]


@pytest.mark.parametrize(
    "op, inputs, params, expected",
    [
        ("sum", ["a", "b"], {}, [11, 22, 33, 44]),
        ("mean", ["a", "b"], {}, [5.5, 11, 16.5, 22]),
        ("difference", ["a", "b"], {}, [-9, -18, -27, -36]),
        ("abs_difference", ["a", "b"], {}, [9, 18, 27, 36]),
        ("weighted_sum", ["a", "b"], {"weights": [2, 0.5]}, [7, 14, 21, 28]),
        ("spread", ["a", "b"], {}, [9, 18, 27, 36]),
        ("rowwise_max", ["a", "b"], {}, [10, 20, 30, 40]),
        ("rowwise_min", ["a", "b"], {}, [1, 2, 3, 4]),
        ("count_above", ["a", "b"], {"threshold": 3}, [1, 1, 2, 2]),
        ("product", ["a", "b"], {}, [10, 40, 90, 160]),
        ("ratio", ["a", "c"], {}, [0, 2, 0, 2]),
        ("per_unit", ["a", "c"], {}, [1, 1, 3, 4 / 3]),
        ("scale", ["a"], {"factor": 20}, [20, 40, 60, 80]),
        ("offset", ["a"], {"offset": 5}, [6, 7, 8, 9]),
        ("clip", ["a"], {"min": 2, "max": 3}, [2, 2, 3, 3]),
        ("binarize_threshold", ["a"], {"threshold": 3}, [0, 0, 1, 1]),
        ("binarize_equals", ["grade"], {"value": "Low"}, [1, 0, 1, 0]),
        ("category_map", ["grade"], {"mapping": {"Low": 0, "High": 2}, "default": -1}, [0, 2, 0, -1]),
    ],
)
def test_exact_values(clean_frame, op, inputs, params, expected):
    got = run(clean_frame, FeatureSpec.of("f", op, inputs, **params))
    assert got == pytest.approx(expected)


def test_log1p_and_sqrt_degenerate(spark):
    df = spark.createDataFrame([(0, -5.0), (1, 0.0), (2, 3.0), (3, -4.0), (4, 9.0)], "k int, x double")
    logs = run(df, FeatureSpec.of("f", "log1p", ["x"]))
    assert all(math.isfinite(v) for v in logs) and logs[1] == 0.0
    roots = run(df, FeatureSpec.of("f", "sqrt", ["x"]))
    assert roots[3:] == [0.0, 3.0] and roots[1] == 0.0


def test_unparseable_text_counts_as_zero(spark):
    df = spark.createDataFrame([(0, "1", 1), (1, "oops", 1), (2, "3", 1)], "k int, x string, y int")
    assert run(df, FeatureSpec.of("f", "sum", ["x", "y"])) == [2, 1, 4]


def test_binarize_equals_on_integers(spark):
    df = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "k int, x int")
    assert run(df, FeatureSpec.of("f", "binarize_equals", ["x"], value="1")) == [1, 0, 1]


def test_is_missing_uses_flag_or_nulls(spark):
    flagged = spark.createDataFrame([(0, 1.0, 0.0), (1, 2.0, 1.0), (2, 3.0, 0.0)], "k int, x double, __missing__x double")
    assert run(flagged, FeatureSpec.of("f", "is_missing", ["x"])) == [0, 1, 0]
    raw = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "k int, x double")
    assert run(raw, FeatureSpec.of("f", "is_missing", ["x"])) == [0, 1, 0]


def test_stateful_ops_reuse_fitted_constants(spark):
    train = spark.createDataFrame([(0, 0.0), (1, 5.0), (2, 10.0)], "k int, x double")
    later = spark.createDataFrame([(0, 4.0)], "k int, x double")
    spec = FeatureSpec.of("f", "normalize_max", ["x"])
    state = fit_features(train, [spec])
    assert run(later, spec, state) == [pytest.approx(0.4)]
    assert run(later, spec, fit_features(later, [spec])) == [pytest.approx(1.0)]

    mm = FeatureSpec.of("g", "min_max_scale", ["x"])
    two = spark.createDataFrame([(0, 10.0), (1, 20.0)], "k int, x double")
    assert run(spark.createDataFrame([(0, 15.0)], "k int, x double"), mm, fit_features(two, [mm])) == [pytest.approx(0.5)]

    z = FeatureSpec.of("z", "zscore", ["x"])
    three = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 20.0)], "k int, x double")
    assert run(spark.createDataFrame([(0, 10.0)], "k int, x double"), z, fit_features(three, [z])) == [0.0]


def test_constant_columns_give_zero(spark):
    const = spark.createDataFrame([(0, 0.0), (1, 0.0)], "k int, x double")
    for op in ("normalize_max", "min_max_scale", "zscore"):
        spec = FeatureSpec.of("f", op, ["x"])
        assert run(const, spec, fit_features(const, [spec])) == [0.0, 0.0]


def test_every_operation_is_finite(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, "x"), (1, -3.0, 1e308, "y"), (2, None, float("nan"), None)],
                               "k int, p double, q double, t string")
    specs = []
    for op, (lo, _hi) in ARITY.items():
        inputs = ["t"] if op in ("binarize_equals", "category_map") else ["p", "q"][: max(lo, 1)] if lo <= 2 else ["p", "q"]
        params = {"weights": [1.0] * len(inputs)} if op == "weighted_sum" else {}
        if op == "clip":
            params = {"min": 0, "max": 1}
        if op == "category_map":
            params = {"mapping": {"x": 1}}
        specs.append(FeatureSpec.of(f"f_{op}", op, inputs, **params))
    state = fit_features(df, specs)
    out = apply_features(df, specs, state).collect()
    for row in out:
        for s in specs:
            assert row[s.name] is not None and math.isfinite(row[s.name]), s.op


def test_invalid_specs_are_dropped_with_a_reason():
    specs = [
        FeatureSpec.of("good", "sum", ["a", "b"]),
        FeatureSpec.of("Also Good", "ratio", ["a", "b"]),
        FeatureSpec.of("bad_input", "sum", ["a", "nope"]),
        FeatureSpec.of("bad_arity", "difference", ["a"]),
        FeatureSpec.of("grade_map", "category_map", ["grade"], mapping={"Low": 1}),
    ]
    kept, dropped = validate_features(specs, ["a", "b"], ["grade"], ["a", "b", "grade"])
    assert [s.name for s in kept] == ["good", "also_good", "grade_map"]
    assert [d[0] for d in dropped] == ["bad_input", "bad_arity"]


def test_mostly_invalid_plan_is_rejected():
    specs = [FeatureSpec.of("good", "sum", ["a", "b"])] + [FeatureSpec.of(f"bad{i}", "log1p", ["grade"]) for i in range(3)]
    with pytest.raises(PlanRejected):
        validate_features(specs, ["a", "b"], ["grade"], ["a", "b", "grade"])
