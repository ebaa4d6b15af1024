"""T5–T10, S7, SC1: one end-to-end fit on `records` (sf0.001) and its invariants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from classcraft.operators.drift import drift_report
from classcraft.operators.explain import attribute, levers
from classcraft.operators.score import score_frame
from classcraft.plans.q_train import fitted
from classcraft.plans.train import FittedModel, TrainConfig, TrainingError, candidate_params, fit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trained(spark):
    return fitted(spark, SF)


def test_quality_floor_and_leaderboard(trained):
    model, board, summary = trained
    rows = board.collect()
    champ = [r for r in rows if r["champion"]]
    assert len(champ) == 1 and champ[0]["score"] > 0.75
    assert champ[0]["model"] == model.champion
    ens = [r for r in rows if r["model"] == "ensemble"]
    assert not ens or ens[0]["cv_mean"] is None
    assert summary["train_rows"] + summary["test_rows"] == summary["rows_used"] == 1500
    assert 0.1 <= summary["test_rows"] / 1500 <= 0.3


def test_scores_are_probabilities_with_labels(spark, trained, records):
    model, _, _ = trained
    scored = score_frame(records, model.scorer())
    agg = scored.agg(F.min("probability"), F.max("probability"), F.count(F.lit(1))).first()
    assert 0.0 <= agg[0] <= agg[1] <= 1.0 and agg[2] == 1500
    assert {r[0] for r in scored.select("prediction").distinct().collect()} <= {"approved", "rejected"}


def test_inputs_survive_scoring_with_a_fitted_model(spark, trained, records):
    model, _, _ = trained
    df = records.withColumns({"raw_x": F.lit("kept"), "probs": F.lit(3), "features": F.col("score")})
    scored = score_frame(df, model.scorer())
    assert scored.select(*df.columns).exceptAll(df).count() == 0 and df.exceptAll(scored.select(*df.columns)).count() == 0
    assert scored.where("balance IS NULL").count() > 0


def test_explanations_compare_raw_values(spark, trained, records):
    model, _, _ = trained
    fields = model.input_schema
    few = records.orderBy("record_id").limit(60)
    rows = {r.record_id: r for r in few.collect()}
    got = levers(few, "record_id", model.scorer(), fields).where("to_number IS NOT NULL").collect()
    assert got and all(float(r.from_value) == pytest.approx(rows[r.record_id][r.column]) for r in got if rows[r.record_id][r.column] is not None)
    default = next(f["default"] for f in fields if f["name"] == "score")
    swapped = score_frame(few.withColumn("score", F.lit(default)), model.scorer()).select("record_id", F.col("probability").alias("p"))
    actual = score_frame(few, model.scorer()).select("record_id", "probability").join(swapped, "record_id")
    want = {r.record_id: r.probability - r.p for r in actual.collect()}
    for r in attribute(few, "record_id", model.scorer(), fields).where("column = 'score'").collect():
        assert r.delta == pytest.approx(want[r.record_id], abs=2e-4)


def test_parameters_are_cast_and_unknown_names_reported():
    params, extra = candidate_params("random_forest", {"n_estimators": "40.0", "max_depth": "none", "gamma": 1}, 60_000)
    assert params == {"n_estimators": 40, "max_depth": 30, "min_samples_leaf": 2} and extra == ["gamma"]
    assert candidate_params("random_forest", {}, 60_000)[0]["n_estimators"] == 150 and candidate_params("random_forest", {}, 60)[0]["n_estimators"] == 300
    with pytest.raises(TrainingError):
        candidate_params("xgboost", {"max_depth": 31}, 10)


def test_multiclass_has_a_boosted_member(spark, records):
    df = records.where("record_id % 3 = 0").withColumn("outcome", F.when(F.col("score") > 60, "high").when(F.col("score") > 30, "mid").otherwise("low"))
    cfg = TrainConfig(target="outcome", key="record_id", folds=2, candidates=("hist_gradient_boosting", "no_such"), metric="balanced_accuracy",
                      params={"hist_gradient_boosting": {"max_iter": 2, "max_depth": 2}})
    model, board, summary = fit(df, cfg)
    assert summary["unknown_candidates"] == ["no_such"] and not summary["failed"] and set(model.members) == {"hist_gradient_boosting"}
    assert len(model.pipeline.stages[-1].fitted().rounds[0]) == 3
    assert board.first().score > 0.7
    total = score_frame(df, model.scorer()).select(F.max(F.abs(F.col("p_high") + F.col("p_low") + F.col("p_mid") - 1))).first()[0]
    assert total < 1e-3


def test_too_few_rows_are_refused(records):
    with pytest.raises(ValueError):
        fit(records.limit(20), TrainConfig(target="outcome", key="record_id"))


def test_drift_from_the_stored_baseline(spark, trained, records, tmp_path):
    model, _, _ = trained
    model.save(spark, str(tmp_path / "m"))
    numeric, levels = FittedModel.load(spark, str(tmp_path / "m")).drift_baseline(spark)
    same = drift_report(records, numeric, levels).collect()
    assert {r.column for r in same} >= {"score", "training"} and all(r.psi < 0.05 for r in same)
    moved = drift_report(records.withColumn("score", F.col("score") * 3), numeric, levels).first()
    assert moved.column == "score" and moved.overall == "alert"


def test_single_row_equals_full_batch(spark, trained, records):
    model, _, _ = trained
    full = {r["record_id"]: r["probability"] for r in score_frame(records, model.scorer()).collect()}
    one = records.where(F.col("record_id") == min(full))
    assert score_frame(one, model.scorer()).first()["probability"] == pytest.approx(full[min(full)], abs=1e-12)


def test_save_load_identity(spark, trained, records, tmp_path):
    model, _, _ = trained
    path = str(tmp_path / "model")
    model.save(spark, path)
    again = FittedModel.load(spark, path)
    a = score_frame(records, model.scorer()).select("record_id", "probability")
    b = score_frame(records, again.scorer()).select("record_id", "probability")
    assert a.exceptAll(b).count() == 0


def test_thin_class_target_is_refused(spark, records):
    df = records.withColumn("outcome", F.when(F.col("record_id") == 1, "odd").otherwise(F.col("outcome")))
    with pytest.raises(TrainingError):
        fit(df, TrainConfig(target="outcome", key="record_id"))


def test_permutation_importance_keeps_rows_without_or_with_equal_keys(spark):
    from pyspark.sql import functions as F

    from classcraft.plans.q_train import M17_COLS, formula2_scorer, records
    from classcraft.plans.train import permutation_importance

    rows = records(spark, "/root/testdata/sf0.001").limit(200)
    for key in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        out = permutation_importance(rows.withColumn("record_id", key), "record_id", formula2_scorer(), list(M17_COLS), "outcome", repeats=2).collect()
        got = {r["column"]: r.importance for r in out}
        assert set(got) == set(M17_COLS) and got["score"] > 0.05 and got["department"] == 0
