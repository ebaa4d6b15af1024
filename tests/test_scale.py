"""What tasks hold and how the work is dealt: it follows the rows, not the files or the settings that the session came with."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from classcraft import session
from classcraft.operators import boosting as B
from classcraft.operators import explain as A
from classcraft.operators import extra_trees as X
from classcraft.operators.score import Scorer
from classcraft.plans import q_train as Q
from classcraft.plans import train as T
from classcraft.plans.tree_models import ForestScore, TreeModel, _tree_dict
from tests.test_trees import brute_forest, cuts_of, filled, made


def slope_scorer(threshold=0.5):
    p = F.expr("1 / (1 + exp(-(a + n - 4)))")
    return Scorer(["no", "yes"], "yes", threshold, lambda df: df.withColumn("probs", F.array(3 * (1 - p), 3 * p)))



def test_one_partition_is_dealt_by_its_rows(spark):
    one = spark.range(60_000).coalesce(1)
    parts = session.dealt(one).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == 3 and max(r["count"] for r in parts) < 25_000
    assert session.dealt(one).agg(F.sum("id")).first()[0] == 60_000 * 59_999 // 2
    assert session.task_count(spark, 1_000) == 1 and session.task_count(spark, 1_000, work=50) == 2
    assert session.task_count(spark, 50_000_000) == 200  # a task's rows stay bounded


def test_fit_reads_scores_without_the_models_that_made_them(spark, monkeypatch):
    seen, paths, measure, path = [], [], T.metric_of, T.scratch_path

    def watched(df, *args):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return measure(df, *args)

    monkeypatch.setattr(T, "metric_of", watched)
    monkeypatch.setattr(T, "scratch_path", lambda s, name: paths.append(path(s, name)) or paths[-1])
    rows = spark.range(120).select("id", (F.col("id") * 7 % 31).cast("double").alias("a"), (F.col("id") * 13 % 17).cast("double").alias("b"),
                                   F.when(F.col("id") * 7 % 31 > 14, "yes").otherwise("no").alias("y"))
    T.fit(rows, T.TrainConfig("y", "id", folds=2, candidates=("logistic_regression",), params={"logistic_regression": {"max_iter": 5}}))
    assert seen and all("InMemoryTableScan" not in plan and "FileScan parquet" in plan for plan in seen)
    assert len(paths) == 2 and not any(Path(p.removeprefix("file:")).exists() for p in paths)


def test_boosting_walks_each_tree_once_and_keeps_the_margins(spark, monkeypatch):
    rows, x, y, w, *_ = made(spark, n=200)
    walked, count = [], B._histograms
    monkeypatch.setattr(B, "_histograms", lambda state, *args: walked.extend(len(g.recent) for g in state) or count(state, *args))
    p = B.BoostParams(rounds=13, max_depth=2, max_bins=16, early_stopping=False)
    model = B.boost(rows, 4, 2, p, 2)[-1]
    assert walked and not any(walked)
    # margins went through two rewrites' worth of rounds: the last round's leaves must be those of the whole sum
    raw = B.Boosted(model.base, model.rounds[:-1], [], 2).raw(x)
    tree, prob = model.rounds[-1][0], B.probabilities(raw)[:, 0]
    node, g, h = tree.walk(x), w * (prob - y), w * prob * (1 - prob)
    for leaf in np.unique(node):
        at = node == leaf
        assert abs(tree.value[leaf] + p.learning_rate * g[at].sum() / h[at].sum()) < 1e-9


def test_forest_of_few_rows_takes_no_pass_a_level(spark, monkeypatch):
    passes, count = [], X._counted
    monkeypatch.setattr(X, "_counted", lambda *args: passes.append(args[-1]) or count(*args))
    rows, x, y, w, _ = filled(spark, n=250, seed=6)
    p = X.ForestParams(trees=6, max_depth=7)
    want = [brute_forest(x, y, w, 2, p, t) for t in range(6)]
    assert [cuts_of(t) for t in X.grow_forest(rows, 4, 2, p)[0].trees] == want and not passes
    # tasks that may hold 60 rows of four features: nodes are counted in passes only as long as they have more than 30
    monkeypatch.setattr(X, "HELD", 4 * 60)
    monkeypatch.setattr(X, "MOVED", 4 * 400)
    rounds, subtrees = [], X._grow_subtrees
    monkeypatch.setattr(X, "_grow_subtrees", lambda state, forest, nodes, unit, *args: rounds.append((forest.n[nodes], unit)) or subtrees(state, forest, nodes, unit, *args))
    assert [cuts_of(t) for t in X.grow_forest(rows, 4, 2, p)[0].trees] == want
    assert passes and max(passes) <= 6 * 250 // 30
    assert len(rounds) > 1 and all(np.bincount(unit, n).max() <= 60 and n.sum() <= 460 for n, unit in rounds)


def test_forest_query_grows_all_trees_at_any_size(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(Q, "fit_joint", lambda name, rows, features, classes, params, *args: asked.append(params) or [])
    for n in (10, T.FEWER_TREES_FROM + 1):
        Q.grown_folds(spark, "extra_trees", 1, spark.range(n), 1, 2)
    assert asked[0] == asked[1] == T.DEFAULTS["extra_trees"]


def test_held_out_rows_are_scored_once_for_the_curve(spark, monkeypatch):
    rows, x, y, *_ = made(spark, n=200)
    rows, curves, whole = rows.withColumn("record_id", F.col("r")), [], Q.M.score_curve
    monkeypatch.setattr(Q.M, "score_curve", lambda df, *by: curves.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df, *by))
    monkeypatch.setattr(Q, "candidate_params", lambda *a: (T.DEFAULTS["hist_gradient_boosting"] | {"max_iter": 4}, []))
    found = Q.grown_folds(spark, "hist_gradient_boosting", 3, rows, 4, 2).collect()
    assert len(curves) == 1 and "Eval" not in curves[0] and [r.held_out for r in found] == [0, 1, 2, None]
    models = B.boost(rows, 4, 2, B.BoostParams(rounds=4, early_stopping=False), 3)
    for r, m in zip(found[:3], models):
        own = np.arange(200) % 3 == r.held_out
        p = m.probabilities(x[own])[:, 1]
        gap = p[y[own] == 1][:, None] - p[y[own] == 0][None, :]
        assert abs(r.roc_auc - ((gap > 0) + (gap == 0) / 2).mean()) < 1e-9
    assert found[3].roc_auc is None


def test_missing_values_hide_no_feature_however_rows_are_dealt(spark, monkeypatch):
    rows, *_ = made(spark, n=240, seed=9)
    p = X.ForestParams(trees=4, max_depth=6, max_features=2)
    whole = X.grow_forest(rows, 4, 2, p, folds=3)
    monkeypatch.setattr(X, "HELD", 4 * 24)
    parted = X.grow_forest(rows.repartition(9), 4, 2, p, folds=3)
    for a, b in zip(whole, parted):
        assert [cuts_of(t) for t in a.trees] == [cuts_of(t) for t in b.trees]
    assert any(f == 2 for t in whole[3].trees for f, _ in cuts_of(t).values())


def test_forest_is_packed_and_older_ones_are_read(spark):
    rows, x, *_ = filled(spark, n=200, seed=7)
    model = X.grow_forest(rows, 4, 2, X.ForestParams(trees=3, max_depth=5))[0]
    stage = TreeModel.of(model, "v", "p")
    listed = json.dumps({"kind": "forest", "classes": 2, "trees": [{k: np.array(v).tolist() for k, v in _tree_dict(t).items()} for t in model.trees],
                         "shares": [s.tolist() for s in model.shares]})
    for again in (stage.fitted(), TreeModel(trees=listed).fitted()):
        assert [cuts_of(t) for t in again.trees] == [cuts_of(t) for t in model.trees] and [t.depth() for t in again.trees] == [t.depth() for t in model.trees]
        assert (ForestScore(again)(x) == ForestScore(model)(x)).all()


FIELDS = [{"name": "a", "kind": "numeric", "min": 0.0, "max": 6.0, "default": 1.0, "integer": False},
          {"name": "n", "kind": "numeric", "min": 0.0, "max": 5.0, "default": 1.0, "integer": True}]


def test_steps_that_round_to_one_number_are_tried_once(spark):
    rows = spark.createDataFrame([(1, 0.5, 0), (2, 0.5, 3), (3, 1.0, None), (4, 6.0, 5)], "k int, a double, n int")
    tried = rows.select("k", F.explode(A._steps(FIELDS)).alias("c")).where("c.field = 1").join(rows, "k")
    numbers = tried.select("k", A._number(FIELDS, F.lit(1), F.col("c.step"), A._now(FIELDS[1])).alias("v")).groupBy("k").agg(
        F.count("v").alias("n"), F.countDistinct("v").alias("d")).collect()
    assert {r.k: (r.n, r.d) for r in numbers} == {1: (6, 6), 2: (3, 3), 3: (6, 6)}


def test_levers_with_whole_numbers_and_scores_that_do_not_sum_to_one(spark):
    rows = spark.createDataFrame([(1, 0.5, 0), (2, 0.5, 3), (3, 1.0, 1), (4, 6.0, 5)], "k int, a double, n int")
    got = {(r.k, r.column): (r.to_number, r.gain) for r in A.levers(rows, "k", slope_scorer(), FIELDS).collect()}
    p = lambda a, n: 1 / (1 + np.exp(-(a + n - 4)))
    want = {}
    for k, a, n in ((1, 0.5, 0), (2, 0.5, 3), (3, 1.0, 1)):
        for name, now, high in (("a", a, 6.0), ("n", n, 5.0)):
            for s in range(1, 25):
                v = high if s == 24 else now + s * ((high - now) / 24)
                v = float(np.rint(v)) if name == "n" else v
                q = p(v, n) if name == "a" else p(a, v)
                if q >= 0.5:
                    want[(k, name)] = (v, round(q - p(a, n), 4))
                    break
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_one_partition_of_records_is_dealt_before_changes_are_tried(spark):
    rows = spark.range(3_000).coalesce(1).select(F.col("id").cast("int").alias("k"), F.lit(0.5).alias("a"), (F.col("id") % 4).cast("int").alias("n"))
    for out in (A.levers(rows, "k", slope_scorer(), FIELDS), A.attribute(rows.unionAll(rows).unionAll(rows).unionAll(rows).unionAll(rows).coalesce(1),
                                                                       "k", slope_scorer(), FIELDS)):
        assert "RoundRobinPartitioning" in out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()


def test_importance_partitions_follow_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(T, "SHUFFLE_ROWS", 10)
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("int").alias("n"),
                                   F.when(F.col("id") % 7 > 2, "yes").otherwise("no").alias("y"))
    out = T.permutation_importance(rows, "k", slope_scorer(), ["a", "n"], "y", repeats=2)
    assert {r.column for r in out.collect()} == {"a", "n"}
    measured, plans = T.M.binary_report_by, []
    monkeypatch.setattr(T.M, "binary_report_by", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or measured(df, *a))
    T.permutation_importance(rows, "k", slope_scorer(), ["a", "n"], "y", repeats=2)
    assert any("RepartitionByExpression [__b" in p and ", 20" in p for p in plans)
