"""T5 by own growers: second-order boosting, softmax, early stopping, folds in common passes, randomised trees; each against plain NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from classcraft.operators import boosting as B
from classcraft.operators import extra_trees as X
from classcraft.operators import metrics as M
from classcraft.plans.tree_models import BoostedScore, ForestScore, TreeModel


def made(spark, n=300, features=4, classes=2, seed=0, folds=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, features))
    x[:, 1] = np.round(x[:, 1])
    x[rng.random(n) < 0.2, 2] = np.nan
    score = x[:, 0] * x[:, 1] + np.where(np.isnan(x[:, 2]), 1.5, x[:, 2]) + 0.5 * rng.normal(size=n)
    y = np.digitize(score, np.quantile(score, np.arange(1, classes) / classes))
    w = np.round(rng.uniform(0.5, 2.0, n), 2)
    fold, r = np.arange(n) % folds, rng.integers(-2 ** 62, 2 ** 62, n)
    rows = spark.createDataFrame([(a.tolist(), int(b), float(c), int(d), int(e)) for a, b, c, d, e in zip(x, y, w, fold, r)],
                                 "x array<double>, y int, w double, fold int, r long").repartition(3)
    return rows, x, y, w, fold, r


def brute_cut(x, g, h, w, edges, p):
    total, best = (g.sum(), h.sum(), w.sum()), []
    below = lambda s: s[1 if p.second_order else 2] + p.l2
    for f in range(x.shape[1]):
        gone = np.isnan(x[:, f])
        for t in range(len(edges[f]) + 1):
            for side in (False, True):
                if side and not gone.any() or t == len(edges[f]) and (side or not gone.any()):
                    continue
                left = (x[:, f] <= (edges[f][t] if t < len(edges[f]) else np.inf)) | (gone & side)
                a = (g[left].sum(), h[left].sum(), w[left].sum())
                b = tuple(q - s for q, s in zip(total, a))
                if min(left.sum(), (~left).sum()) < max(p.min_samples_leaf, 1) or min(a[1], b[1]) < p.min_child_weight - 1e-12:
                    continue
                gain = a[0] ** 2 / below(a) + b[0] ** 2 / below(b) - total[0] ** 2 / below(total)
                best.append((gain, f, t, side, left))
    if not best or max(c[0] for c in best) <= 1e-12 * total[2]:
        return None
    top = max(c[0] for c in best)
    return next(c for c in best if c[0] >= top - 1e-9 * top)


def brute_tree(x, g, h, w, edges, p):
    """Best-first growth, one split after another: (splits by path, value of each row)."""
    nodes = {"": np.arange(len(x))}
    cuts = {path: brute_cut(x[i], g[i], h[i], w[i], edges, p) for path, i in nodes.items()}
    splits, leaves = {}, 1
    while p.max_leaf_nodes is None or leaves < p.max_leaf_nodes:
        ready = [path for path in nodes if path not in splits and cuts[path] is not None and len(path) < p.max_depth]
        if not ready:
            break
        path = max(ready, key=lambda q: cuts[q][0])
        _, f, t, side, left = cuts[path]
        splits[path] = (f, t, side)
        for mark, part in (("L", left), ("R", ~left)):
            child = nodes[path][part]
            nodes[path + mark] = child
            cuts[path + mark] = brute_cut(x[child], g[child], h[child], w[child], edges, p) if len(child) >= 2 * p.min_samples_leaf else None
        leaves += 1
    value = np.zeros(len(x))
    for path, i in nodes.items():
        if path not in splits:
            value[i] = -p.learning_rate * g[i].sum() / (h[i].sum() + p.l2)
    return splits, value


def splits_of(tree, node=0, path=""):
    if tree.left[node] < 0:
        return {}
    return ({path: (tree.feature[node], tree.cut[node], tree.missing_left[node])}
            | splits_of(tree, tree.left[node], path + "L") | splits_of(tree, tree.right[node], path + "R"))


def brute_boost(x, y, w, edges, classes, p, rounds):
    width = 1 if classes == 2 else classes
    share = np.array([w[y == c].sum() for c in range(classes)]) / w.sum()
    raw = np.tile([np.log(share[1] / share[0])] if width == 1 else np.log(share), (len(x), 1))
    trees, losses = [], []
    for _ in range(rounds):
        prob = B.probabilities(raw)
        new = raw.copy()
        trees.append([])
        for c in range(width):
            target = (y == (1 if width == 1 else c)).astype(float)
            splits, value = brute_tree(x, w * (prob[:, c] - target), w * prob[:, c] * (1 - prob[:, c]), w, edges, p)
            trees[-1].append(splits)
            new[:, c] += value
        raw = new
        losses.append(float((B._loss(raw, y) * w).sum() / w.sum()))
    return trees, raw, losses


@pytest.mark.parametrize("more", [dict(), dict(l2=1.0, min_samples_leaf=1, min_child_weight=1.0, max_leaf_nodes=None), dict(second_order=False, min_samples_leaf=1),
                                  dict(max_leaf_nodes=6, min_samples_leaf=5)])
def test_boosting_split_by_split(spark, more):
    rows, x, y, w, *_ = made(spark)
    p = B.BoostParams(rounds=4, max_depth=4, max_bins=24, early_stopping=False, **more)
    edges = B.bin_edges(rows, 4, 24)
    model = B.boost(rows, 4, 2, p)[0]
    trees, raw, _ = brute_boost(x, y, w, edges, 2, p, 4)
    assert [[splits_of(t) for t in ts] for ts in model.rounds] == trees
    assert any(side for ts in trees for t in ts for _, _, side in t.values())
    assert np.allclose(model.raw(x), raw, atol=1e-9)
    assert np.allclose(BoostedScore(model)(x), model.probabilities(x), atol=1e-12)


def test_softmax_shares_margins_and_betters_every_round(spark):
    rows, x, y, w, *_ = made(spark, classes=3, seed=2)
    p = B.BoostParams(rounds=5, max_depth=3, max_bins=20, min_samples_leaf=5, early_stopping=False)
    model = B.boost(rows, 4, 3, p)[0]
    trees, raw, losses = brute_boost(x, y, w, B.bin_edges(rows, 4, 20), 3, p, 5)
    assert [[splits_of(t) for t in ts] for ts in model.rounds] == trees and np.allclose(model.raw(x), raw, atol=1e-9)
    assert all(a > b for a, b in zip(losses, losses[1:]))
    assert np.allclose(model.probabilities(x).sum(axis=1), 1)


def test_margins_written_anew_change_nothing(spark, monkeypatch):
    rows, x, *_ = made(spark, seed=3)
    p = B.BoostParams(rounds=7, max_depth=2, early_stopping=False)
    whole = B.boost(rows, 4, 2, p)[0]
    monkeypatch.setattr(B, "REFRESH", 2)
    monkeypatch.setattr(B, "BLOCK_CELLS", 7)
    again = B.boost(rows, 4, 2, p)[0]
    assert [[splits_of(t) for t in ts] for ts in whole.rounds] == [[splits_of(t) for t in ts] for ts in again.rounds]
    assert np.allclose(whole.raw(x), again.raw(x), atol=1e-9)


def test_early_stopping_equals_scoring_all_rounds(spark):
    rows, x, y, w, _, r = made(spark, n=500, seed=4)
    p = B.BoostParams(rounds=60, max_depth=3, learning_rate=0.4, early_stopping=True, validation=0.25, patience=4)
    model = B.boost(rows, 4, 2, p)[0]
    held = B.mixed(r, p.seed) < p.validation
    assert 60 > len(model.rounds) > 4
    losses = []
    for n in range(len(model.rounds) + 1):
        raw = B.Boosted(model.base, model.rounds[:n], [], 2).raw(x[held])
        losses.append(float((B._loss(raw, y[held]) * w[held]).sum() / w[held].sum()))
    assert np.allclose(losses, model.losses, atol=1e-9)
    stops = [n for n in range(len(losses)) if B.should_stop(losses[:n + 1], p.patience, p.tolerance)]
    assert stops == [len(model.rounds)]
    assert not B.should_stop([1.0, 0.9, 0.8], 2, 0.0) and B.should_stop([0.8, 0.8, 0.9], 2, 0.0)


def test_folds_grown_together_equal_folds_grown_alone(spark):
    rows, x, y, w, fold, _ = made(spark, seed=5)
    p = B.BoostParams(rounds=3, max_depth=3, max_bins=255, early_stopping=False, subsample=0.8)
    models = B.boost(rows, 4, 2, p, folds=3)
    edges = B.bin_edges(rows, 4, 255)
    for f in (0, 1, 2, None):
        part = rows if f is None else rows.where(F.col("fold") != f)
        original = B.bin_edges
        B.bin_edges = lambda *_: edges          # the bins are those of all rows
        try:
            alone = B.boost(part, 4, 2, p)[0]
        finally:
            B.bin_edges = original
        together = models[3 if f is None else f]
        assert [[splits_of(t) for t in ts] for ts in alone.rounds] == [[splits_of(t) for t in ts] for ts in together.rounds]
        assert np.allclose(alone.raw(x), together.raw(x), atol=1e-9)


def test_one_scan_a_level(spark, monkeypatch):
    passes = []
    whole = B._pass
    monkeypatch.setattr(B, "_pass", lambda *a: passes.append(1) or whole(*a))
    rows, *_ = made(spark, classes=3)
    B.boost(rows, 4, 3, B.BoostParams(rounds=2, max_depth=3, early_stopping=False), folds=3)
    assert len(passes) == 2 * 3


@pytest.mark.parametrize("classes, more", [(2, dict(early_stopping=True, validation=0.25, patience=3)), (3, dict(early_stopping=False, max_leaf_nodes=5)),
                                           (2, dict(subsample=0.7, max_leaf_nodes=None, min_samples_leaf=1, l2=1.0, early_stopping=False)),
                                           (3, dict(early_stopping=True, patience=2, second_order=False))])
def test_models_grown_in_tasks_equal_those_grown_in_passes(spark, monkeypatch, classes, more):
    rows, x, *_ = made(spark, n=400, features=6, classes=classes, seed=11)
    rows = rows.withColumn("w", F.when(F.col("r") % 17 == 0, 0.0).otherwise(F.col("w")))
    p = B.BoostParams(rounds=9, **{"max_depth": 4, "max_bins": 20, "learning_rate": 0.3, "min_samples_leaf": 5, **more})
    passes = B.boost(rows, 6, classes, p, folds=2)
    monkeypatch.setattr(B, "_pass", None)
    tasks = B.boosted(rows, 6, classes, p, folds=2)
    for a, b in zip(passes, tasks, strict=True):
        assert [[splits_of(t) for t in ts] for ts in a.rounds] == [[splits_of(t) for t in ts] for ts in b.rounds]
        assert a.base == b.base and np.allclose(a.losses, b.losses, atol=1e-12) and np.allclose(a.raw(x), b.raw(x), atol=1e-9)
    monkeypatch.setattr(B, "HELD", 400 * 6 - 1)
    with pytest.raises(TypeError):          # more rows than a task may hold: passes
        B.boosted(rows, 6, classes, p, folds=2)


def test_joint_cells_add_up_by_feature():
    rng = np.random.default_rng(0)
    layout = B.Layout([np.arange(k) + 0.5 for k in (1, 30, 0, 2, 300, 1)])
    bins = np.stack([rng.integers(0, len(e) + 2, 500) for e in layout.edges], axis=1).astype(np.uint16)
    held = B._Held(bins, np.zeros(500), np.ones(500), np.zeros(500), 480, layout)
    assert len(held.bundles) < 6
    slot, g = rng.integers(-1, 3, 480), rng.normal(size=480)
    got = held.histograms([g, g * g, np.ones(480)], slot, 3)
    for s in range(3):
        for f in range(6):
            own = slot == s
            span = got[s, :, layout.offsets[f]:layout.offsets[f + 1]]
            assert np.allclose(span[0], np.bincount(bins[:480, f][own], g[own], span.shape[1])) and span[3].sum() == own.sum()


def test_bins(spark):
    rows = spark.createDataFrame([([float(i % 7), float(i), float("nan")],) for i in range(5000)], "x array<double>")
    few, many, none = B.bin_edges(rows, 3, 50)
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and len(none) == 0
    counts = np.bincount(np.searchsorted(many, np.arange(5000), "left"))
    assert 45 <= len(many) < 50 and counts.max() <= 130
    layout = B.Layout([few, many, none])
    assert layout.binned(np.array([[0.5, -1.0, np.nan], [0.6, 1e9, 3.0]])).tolist() == [[0, 0, 1], [1, len(many), 0]]


# ── randomised trees ────────────────────────────────────────────────────────
def brute_forest(x, y, w, classes, p, tree):
    """Splits by path of one tree, grown node by node."""
    features, out = x.shape[1], {}
    use = p.max_features or max(1, int(np.sqrt(features)))
    open_ = [("", 1, np.arange(len(x)))]
    while open_:
        path, number, rows = open_.pop()
        if len(path) >= p.max_depth or len(rows) < max(2, 2 * p.min_samples_leaf) or len(set(y[rows])) < 2:
            continue
        where, share = (X.drawn(p.seed, np.array([tree]), np.array([number]), features, s)[0] for s in (0, 1))
        order, step = np.argsort(where, kind="stable"), min(features, X.DRAWN * use)
        tries = []
        for start in range(0, features, step):
            tries = [f for f in order[start:start + step] if x[rows, f].min() < x[rows, f].max()][:use]
            if tries:
                break
        best = None
        for f in tries:
            low, high = x[rows, f].min(), x[rows, f].max()
            cut = low + share[f] * (high - low)
            cut = cut if cut < high else low
            left = x[rows, f] <= cut
            if min(left.sum(), (~left).sum()) < p.min_samples_leaf:
                continue
            sums = [np.array([w[rows][side & (y[rows] == c)].sum() for c in range(classes)]) for side in (left, ~left)]
            quality = sum((s ** 2).sum() / s.sum() for s in sums)
            if best is None or quality > best[0] + 1e-12:
                best = (quality, f, cut, left)
        if best:
            out[path] = (int(best[1]), float(best[2]))
            open_ += [(path + "L", 2 * number, rows[best[3]]), (path + "R", 2 * number + 1, rows[~best[3]])]
    return out


def cuts_of(tree, node=0, path=""):
    if tree.left[node] < 0:
        return {}
    return {path: (tree.feature[node], tree.threshold[node])} | cuts_of(tree, tree.left[node], path + "L") | cuts_of(tree, tree.right[node], path + "R")


def filled(spark, **more):
    rows, x, y, w, fold, r = made(spark, **more)
    return rows.withColumn("x", F.transform("x", lambda v: F.when(F.isnan(v), 0.0).otherwise(v))), np.nan_to_num(x), y, w, fold


@pytest.mark.parametrize("classes, more", [(2, {}), (3, dict(max_features=1, min_samples_leaf=1, max_depth=5))])
def test_randomised_trees_against_brute_force(spark, monkeypatch, classes, more):
    rows, x, y, w, _ = filled(spark, n=250, classes=classes, seed=6)
    monkeypatch.setattr(X, "NODES", 17)
    p = X.ForestParams(trees=6, **{"max_depth": 7, **more})
    forest = X.grow_forest(rows, 4, classes, p)[0]
    assert [cuts_of(t) for t in forest.trees] == [brute_forest(x, y, w, classes, p, t) for t in range(6)]
    share = ForestScore(forest)(x)
    assert np.allclose(share.sum(axis=1), 1) and (share.argmax(axis=1) == y).mean() > 0.6


def test_constant_features_are_passed_over(spark):
    rng = np.random.default_rng(1)
    x = np.hstack([np.ones((80, 12)), rng.normal(size=(80, 1))])
    y = (x[:, 12] > 0).astype(int)
    rows = spark.createDataFrame([(a.tolist(), int(b), 1.0) for a, b in zip(x, y)], "x array<double>, y int, w double")
    p = X.ForestParams(trees=5, max_features=1, min_samples_leaf=1)
    forest = X.grow_forest(rows, 13, 2, p)[0]
    assert all({f for f, _ in cuts_of(t).values()} == {12} for t in forest.trees)
    assert [cuts_of(t) for t in forest.trees] == [brute_forest(x, y, np.ones(80), 2, p, t) for t in range(5)]


def test_thresholds_are_inside_and_folds_equal(spark):
    rows, x, y, w, fold = filled(spark, n=200, seed=7)
    p = X.ForestParams(trees=4, max_depth=5)
    together = X.grow_forest(rows, 4, 2, p, folds=3)
    for f in (0, 1, 2, None):
        alone = X.grow_forest(rows if f is None else rows.where(F.col("fold") != f), 4, 2, p)[0]
        assert [cuts_of(t) for t in alone.trees] == [cuts_of(t) for t in together[3 if f is None else f].trees]
    for tree in together[3].trees:
        assert all(x[:, f].min() <= cut < x[:, f].max() for f, cut in cuts_of(tree).values())


def test_weights_move_the_shares(spark):
    rows, x, y, w, _ = filled(spark, n=200, seed=8)
    p = X.ForestParams(trees=10, max_depth=2)
    plain = ForestScore(X.grow_forest(rows.withColumn("w", F.lit(1.0)), 4, 2, p)[0])(x)
    heavy = ForestScore(X.grow_forest(rows.withColumn("w", F.when(F.col("y") == 1, 5.0).otherwise(1.0)), 4, 2, p)[0])(x)
    assert heavy[:, 1].mean() > plain[:, 1].mean() + 0.1


def test_no_rows_of_weight_and_one_class(spark):
    rows, x, *_ = filled(spark, n=60)
    only = X.grow_forest(rows.withColumn("y", F.lit(0)), 4, 2, X.ForestParams(trees=2))[0]
    assert [len(t.left) for t in only.trees] == [1, 1] and ForestScore(only)(x)[:, 0].min() == 1.0
    flat = B.boost(rows.withColumn("y", F.lit(0)), 4, 2, B.BoostParams(rounds=2, early_stopping=False))[0]
    assert flat.probabilities(x)[:, 0].min() > 0.99


# ── as a stage, and against MLlib ───────────────────────────────────────────
def test_stage_is_saved_and_scores_alike(spark, tmp_path):
    rows, x, *_ = made(spark)
    model = B.boost(rows, 4, 2, B.BoostParams(rounds=3, early_stopping=False))[0]
    stage = TreeModel.of(model, "v", "p")
    stage.write().overwrite().save(str(tmp_path / "stage"))
    again = TreeModel.load(str(tmp_path / "stage"))
    frame = rows.select("r", "x", array_to_vector("x").alias("v"))
    got = {r.r: r.p for r in again.transform(frame).select("r", vector_to_array("p").alias("p")).collect()}
    want = {r.r: model.probabilities(np.array([r.x]))[0] for r in frame.select("r", "x").collect()}
    assert all(np.allclose(got[k], want[k]) for k in want)
    assert again.transform(frame.limit(0)).count() == 0


def test_at_least_as_good_as_first_order_boosting(spark, records):
    x = F.array(*[F.col(c).cast("double") for c in ("score", "attendance", "aptitude", "projects", "backlogs", "rating")])
    rows = records.select(x.alias("x"), (F.col("outcome") == "approved").cast("int").alias("y"), F.lit(1.0).alias("w"),
                          F.xxhash64("record_id").alias("r"), (F.col("record_id") % 5).cast("int").alias("fold")).cache()
    learn, test = rows.where("fold > 0"), rows.where("fold = 0")
    model = TreeModel.of(B.boost(learn, 6, 2, B.BoostParams(rounds=40))[0], "v", "p")
    first = GBTClassifier(featuresCol="v", labelCol="y", maxIter=40, stepSize=0.08, maxDepth=6, seed=1).fit(learn.withColumn("v", array_to_vector("x")))
    frame = test.withColumn("v", array_to_vector("x"))
    auc = lambda df, c: M.auc_from_curve(M.score_curve(df.select("y", F.element_at(vector_to_array(c), 2).alias("p")))).first()["roc_auc"]
    assert auc(model.transform(frame), "p") >= auc(first.transform(frame), "probability")
