"""Registered queries: encoding, splitting and training.

Queries that need a fitted model share one fit per data directory within a
process (the fit itself is a chain of distributed jobs; refitting it for each
report would only repeat identical work).
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from classcraft.catalog import records_cte, register
from classcraft.operators import encode as E
from classcraft.operators import metrics as M
from classcraft.operators import roles, target
from classcraft.operators.boosting import boosted
from classcraft.operators.clean import apply_cleaning
from classcraft.operators.score import score_frame
from classcraft.plans.flagship import train_records
from classcraft.plans.q_features import C15_COLS, GAPPY, _auto_clean
from classcraft.plans.q_profile import RECORD_COLS_SQL, RECORDS_DUP, records_dup, scratch
from classcraft.plans.q_scoring import FORMULA2_SQL, formula2_scorer
from classcraft.plans.train import DEFAULTS, FittedModel, candidate_params, champion_of, dataset_summary, leaderboard, metric_of, permutation_importance
from classcraft.plans.tree_models import TreeModel, boost_params, fit_joint
from classcraft.session import dealt, drop_scratch, scratch_path
from classcraft.sources.store import ModelStore
from classcraft.sources.tables import FORMULA_SCORE_SQL, records, table

_FITS: dict[tuple, tuple] = {}


def fitted(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITS:
        _FITS.clear()  # a fit does not outlive its session
        _FITS[key] = train_records(spark, sf)
    return _FITS[key]


# ── T1, T2 (SQL-checkable) ──────────────────────────────────────────────────
@register("t1_label_encode", "SELECT l_orderkey, l_linenumber, l_returnflag, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS label FROM lineitem")
def t1_label_encode(spark, sf):
    li = table(spark, sf, "lineitem")
    assert target.target_guard(li, "l_returnflag").isEmpty()  # more than 20 classes would be refused
    labels = sorted(r["value"] for r in target.class_counts(li, "l_returnflag").collect())
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", E.label_index(F.col("l_returnflag"), labels).alias("label"))


@register("t2_sample_weights", "WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) "
          "SELECT doc_id, l.quality, (SELECT sum(n) FROM c) / (2.0 * c.n) AS weight FROM labels l JOIN c USING (quality)")
def t2_sample_weights(spark, sf):
    lab = table(spark, sf, "labels")
    counts = {str(r[0]): r[1] for r in lab.groupBy("quality").count().collect()}
    w = E.class_weights(counts, "balanced")
    return lab.select("doc_id", "quality", E.weight_column(F.col("quality"), w).alias("weight"))


# ── T3, T4 ──────────────────────────────────────────────────────────────────
def _placed(seed: int, extra: str = "") -> str:
    return (f"pl AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY left(md5(CAST(record_id AS VARCHAR) || '|{seed}'), 13)) AS rn, "
            f"count(*) OVER (PARTITION BY outcome) AS n FROM records{extra})")


def _counts(df):
    return {r["value"]: r["n"] for r in target.class_counts(df, "outcome").collect()}


SPLIT_SQL = _placed(42) + ", sp AS (SELECT *, CASE WHEN rn <= greatest(1, least(n - 1, CAST(floor(0.2 * n + 0.5) AS BIGINT))) THEN 'test' ELSE 'train' END AS split FROM pl)"


@register("t3_stratified_split", records_cte(SPLIT_SQL) + "SELECT record_id, split FROM sp")
def t3_stratified_split(spark, sf):
    r = records(spark, sf)
    return r.select("record_id", E.split_column(r, "record_id", "outcome", _counts(r), 0.2).alias("split"))


@register("t4_folds", records_cte(_placed(43)) + "SELECT record_id, CAST(floor((rn - 1) * 3 / n) AS INTEGER) AS fold FROM pl")
def t4_folds(spark, sf):
    r = records(spark, sf)
    return r.select("record_id", E.fold_column(r, "record_id", "outcome", _counts(r), 3).alias("fold"))


RARE = "CASE WHEN record_id % 300 = 7 THEN 'rare' ELSE outcome END"
RARE_SQL = ("rr AS (SELECT record_id, " + RARE + " AS y FROM records), "
            "rs AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY left(md5(CAST(record_id AS VARCHAR) || '|42'), 13)) AS a, "
            "row_number() OVER (PARTITION BY y ORDER BY left(md5(CAST(record_id AS VARCHAR) || '|43'), 13)) AS b, count(*) OVER (PARTITION BY y) AS n FROM rr)")


@register("t3_t4_rare_class", records_cte(RARE_SQL) + (
    "SELECT y, CASE WHEN a <= greatest(1, least(n - 1, CAST(floor(0.2 * n + 0.5) AS BIGINT))) THEN 'test' ELSE 'train' END AS split, "
    "CAST(floor((b - 1) * 3 / n) AS INTEGER) AS fold, count(*) AS n FROM rs GROUP BY ALL"))
def t3_t4_rare_class(spark, sf):
    """A class of a few rows has its share of the test rows and a row in every fold."""
    r = records(spark, sf).select("record_id", F.expr(RARE).alias("y"))
    counts = {x["value"]: x["n"] for x in target.class_counts(r, "y").collect()}
    out = r.select("y", E.split_column(r, "record_id", "y", counts, 0.2).alias("split"), E.fold_column(r, "record_id", "y", counts, 3).alias("fold"))
    return out.groupBy("y", "split", "fold").agg(F.count(F.lit(1)).alias("n"))


# ── T5 (rows: fitted models) ────────────────────────────────────────────────
@register("t5_fit_candidates")
def t5_fit_candidates(spark, sf):
    _model, board, _summary = fitted(spark, sf)
    return board.where(F.col("model") != "ensemble").select("model", "score", "cv_mean", "cv_std", "threshold")


@contextmanager
def boosting_rows(spark, sf, label: str, classes: int):
    """All `records` as the growers read them, with five folds; a missing balance stays missing. They are written once, as cut-offs, bins,
    growth and scores all read them, and deleted in the end. They stay in the partitions that they came in: approximate quantiles depend on these."""
    number = [F.col(c).cast("double") for c in ("score", "attendance", "aptitude", "balance", "projects", "backlogs", "rating")]
    stipend = F.expr("try_cast(replace(stipend, ',', '') AS DOUBLE)")
    levels = [(F.trim("department") == d).cast("double") for d in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "RARE")]
    x = [F.coalesce(c, F.lit(float("nan"))) for c in (*number, stipend, *levels, (F.col("training") == "Yes").cast("double"))]
    given = records(spark, sf).select("record_id", F.array(*x).alias("x"), F.expr(label).cast("int").alias("y"), F.xxhash64("record_id").alias("r"))
    path = scratch_path(spark, "rows")
    try:
        given.write.parquet(path)
        rows = spark.read.schema(given.schema).parquet(path)
        counts = {r.y: r.n for r in rows.groupBy(F.col("y").cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
        weights = E.class_weights(counts, "balanced")
        fold = E.fold_column(rows, "record_id", "y", counts, 5)
        yield rows.select("record_id", "x", "y", E.weight_column(F.col("y"), weights).alias("w"), "r", fold.alias("fold")), len(x), classes
    finally:
        drop_scratch(spark, path)


APPROVED = "CASE WHEN outcome = 'approved' THEN 1 ELSE 0 END"
THREE_BANDS = "CASE WHEN score / 20 + projects + (record_id * 104729) % 1000 / 500.0 > 6.5 THEN 2 WHEN score / 20 + projects + (record_id * 104729) % 1000 / 500.0 > 4 THEN 1 ELSE 0 END"


def grown_folds(spark, name, folds, rows, features, classes):
    """One row a model (a held-out fold, or none) with its trees and the ROC-AUC on the rows of its fold."""
    n = rows.count()
    params, _ = candidate_params(name, DEFAULTS[name], n)      # as many trees for a large table as for a small one
    models = fit_joint(name, rows, features, classes, params, folds, E.SEED)
    trees = [[t for ts in m.rounds for t in ts] if name != "extra_trees" else m.trees for m in models]
    aucs = _held_out_aucs(rows, models, trees, folds, n)
    return spark.createDataFrame([(f if f < folds else None, len(ts), sum(int((np.array(t.left) < 0).sum()) for t in ts), max((t.depth() for t in ts), default=0), aucs.get(f))
                                  for f, ts in enumerate(trees)], "held_out int, trees int, leaves int, depth int, roc_auc double")


def _held_out_aucs(rows, models, trees, folds, n) -> dict[int, float | None]:
    """ROC-AUC of each fold under the model that left it out. The scores are written first: the curve reads them several times."""
    spark, path, parts = rows.sparkSession, scratch_path(rows.sparkSession, "scored"), []
    for f, (m, ts) in enumerate(zip(models[:folds], trees)):
        held_out = dealt(rows.where(F.col("fold") == f), n, len(ts))
        scored = TreeModel.of(m, "v", "p").transform(held_out.withColumn("v", array_to_vector("x")))
        parts.append(scored.select(F.lit(f).alias("fold"), "y", F.element_at(vector_to_array("p"), 2).alias("p")))
    if not parts:
        return {}
    every = reduce(lambda a, b: a.unionAll(b), parts)
    try:
        every.write.parquet(path)
        scores = spark.read.schema(every.schema).parquet(path)
        return {r.fold: r.roc_auc for r in M.auc_from_curve(M.score_curve(scores, ["fold"]), ["fold"]).collect()}
    finally:
        drop_scratch(spark, path)


@register("t5_hist_boosting")
def t5_hist_boosting(spark, sf):
    """T5 with the full defaults: second-order histogram boosting over all `records`, five folds and the whole in the same passes."""
    with boosting_rows(spark, sf, APPROVED, 2) as given:
        return grown_folds(spark, "hist_gradient_boosting", 5, *given)


@register("t5_extra_trees")
def t5_extra_trees(spark, sf):
    """T5 with the full defaults: randomised trees over all `records`, without one fold and of the whole in the same passes."""
    with boosting_rows(spark, sf, APPROVED, 2) as given:
        return grown_folds(spark, "extra_trees", 1, *given)


@register("t5_softmax_boosting")
def t5_softmax_boosting(spark, sf):
    """T5 with three classes and early stopping: the log loss on the rows held out before each round, up to the stop."""
    with boosting_rows(spark, sf, THREE_BANDS, 3) as (rows, features, classes):
        params, _ = candidate_params("hist_gradient_boosting", {}, rows.count())
        model = boosted(rows, features, classes, replace(boost_params("hist_gradient_boosting", params, E.SEED), early_stopping=True))[0]
    return spark.createDataFrame([(i, loss, len(model.rounds)) for i, loss in enumerate(model.losses)], "round int, log_loss double, rounds int")


# ── T8, T9, T10 (fixed-formula members) ─────────────────────────────────────
MEMBERS = (("first", FORMULA_SCORE_SQL), ("second", FORMULA2_SQL), ("third", f"round(1 - {FORMULA_SCORE_SQL}, 6)"))
AUC_SQL = ("(sum(CASE WHEN outcome = 'approved' THEN r ELSE 0 END) - count(*) FILTER (outcome = 'approved') * (count(*) FILTER (outcome = 'approved') + 1) / 2.0) "
           "/ (count(*) FILTER (outcome = 'approved') * count(*) FILTER (outcome <> 'approved'))")


def _member_scores(where: str, by: str) -> str:
    parts = [f"SELECT '{name}' AS model, {i} AS position, {by} AS part, outcome, {sql} AS p FROM sp WHERE {where}" for i, (name, sql) in enumerate(MEMBERS)]
    return ("(SELECT model, position, part, " + AUC_SQL + " AS score FROM (SELECT *, rank() OVER (PARTITION BY model, part ORDER BY p) "
            "+ (count(*) OVER (PARTITION BY model, part, p) - 1) / 2.0 AS r FROM (" + " UNION ALL ".join(parts) + ")) GROUP BY ALL)")


BOARD_SQL = records_cte(SPLIT_SQL) + (
    ", hold AS " + _member_scores("split = 'test'", "0") + ", cv AS " + _member_scores("split = 'train'", "record_id % 3")
    + ", board AS (SELECT h.model, h.position, h.score, avg(c.score) AS cv_mean, stddev_pop(c.score) AS cv_std FROM hold h JOIN cv c USING (model) GROUP BY 1, 2, 3) ")


def formula_board(spark, sf):
    """The leaderboard of three formula members: fold scores on the training rows, hold-out scores on the test rows."""
    r = records(spark, sf)
    r = r.select("record_id", "outcome", E.split_column(r, "record_id", "outcome", _counts(r), 0.2).alias("split"),
                 *[F.expr(sql).alias(name) for name, sql in MEMBERS])
    y = F.when(F.col("outcome") == "approved", 0.0).otherwise(1.0).alias("label")
    contenders, folds = [], []
    for i, (name, _) in enumerate(MEMBERS):
        rows = r.select("record_id", "split", y, F.array(F.col(name), 1 - F.col(name)).alias("probs"))
        score = lambda part: metric_of(part, F.col("probs"), ["approved", "rejected"], "approved", 0.5, "roc_auc")
        contenders.append((name, i, score(rows.where("split = 'test'")), 0.0, 1.0, 0.5))
        folds += [(name, score(rows.where(f"split = 'train' AND record_id % 3 = {f}"))) for f in range(3)]
    return leaderboard(spark.createDataFrame(contenders, "model string, position int, score double, seconds double, weight double, threshold double"),
                       spark.createDataFrame(folds, "model string, score double"))


@register("t8_choose_champion", BOARD_SQL + "SELECT model, round(score, 6) AS score FROM board ORDER BY board.score DESC, position LIMIT 1")
def t8_choose_champion(spark, sf):
    return champion_of(formula_board(spark, sf)).select("model", F.round("score", 6).alias("score"))


@register("t9_leaderboard", BOARD_SQL + "SELECT model, position, round(score, 6) AS score, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std FROM board")
def t9_leaderboard(spark, sf):
    return formula_board(spark, sf).select("model", "position", *[F.round(c, 6).alias(c) for c in ("score", "cv_mean", "cv_std")])


T10_SQL = records_cte(RECORDS_DUP, "u AS (SELECT DISTINCT * FROM records_dup)", SPLIT_SQL.replace("FROM records)", "FROM u)"))


@register("t10_dataset_summary", T10_SQL + (
    "SELECT 'rows_supplied' AS item, (SELECT count(*) FROM records_dup) AS value UNION ALL SELECT 'rows_used', count(*) FROM sp "
    "UNION ALL SELECT 'rows_dropped', (SELECT count(*) FROM records_dup) - count(*) FROM sp UNION ALL SELECT 'columns', 14 "
    "UNION ALL SELECT split || '_rows', count(*) FROM sp GROUP BY split UNION ALL SELECT 'class_' || outcome, count(*) FROM sp GROUP BY outcome"))
def t10_dataset_summary(spark, sf):
    """T10 of the records with repeated rows: supplied, used after F2, dropped, by side and by class."""
    df = records_dup(spark, sf)
    used = roles.drop_duplicate_rows(df)
    split = E.split_column(used, "record_id", "outcome", _counts(used), 0.2)
    counts = used.groupBy(split.alias("split"), F.col("outcome").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return dataset_summary(df.count(), len(df.columns), counts)


# ── T6, T7 (SQL-checkable with fixed-formula members) ───────────────────────
@register("t6_soft_vote", records_cte() + (
    f", m AS (SELECT record_id, {FORMULA_SCORE_SQL} AS a, {FORMULA2_SQL} AS b FROM records) "
    "SELECT record_id, a * 0.75 + b * 0.25 AS p_approved, (1 - a) * 0.75 + (1 - b) * 0.25 AS p_rejected FROM m"))
def t6_soft_vote(spark, sf):
    r = records(spark, sf).select("record_id", F.expr(FORMULA_SCORE_SQL).alias("a"), F.expr(FORMULA2_SQL).alias("b"))
    vote = E.soft_vote([F.array("a", 1 - F.col("a")), F.array("b", 1 - F.col("b"))], [3.0, 1.0])
    return r.select("record_id", F.element_at(vote, 1).alias("p_approved"), F.element_at(vote, 2).alias("p_rejected"))


@register("t7_align_classes", records_cte() + (
    f"SELECT record_id, {FORMULA_SCORE_SQL} AS approved, 1 - {FORMULA_SCORE_SQL} AS rejected, 0.0 AS waitlisted FROM records"))
def t7_align_classes(spark, sf):
    """A member trained on [rejected, approved] realigned to [approved, rejected, waitlisted]."""
    p = F.expr(FORMULA_SCORE_SQL)
    r = records(spark, sf).select("record_id", F.array(1 - p, p).alias("m"))
    a = E.align_probs(F.col("m"), ["rejected", "approved"], ["approved", "rejected", "waitlisted"])
    return r.select("record_id", F.element_at(a, 1).alias("approved"), F.element_at(a, 2).alias("rejected"),
                    F.element_at(a, 3).alias("waitlisted"))


# ── E1–E4 ───────────────────────────────────────────────────────────────────
@register("e2_standardize", records_cte(
    "c AS (SELECT record_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM records)) AS {c}" for c in C15_COLS) + " FROM records)") + (
    "SELECT record_id, " + ", ".join(
        f"round(CASE WHEN (SELECT stddev_pop({c}) FROM c) > 0 THEN ({c} - (SELECT avg({c}) FROM c)) / (SELECT stddev_pop({c}) FROM c) ELSE 0.0 END, 6) AS {c}"
        for c in C15_COLS) + " FROM c"))
def e2_standardize(spark, sf):
    df, rows, numeric, categorical, state = _auto_clean(spark, sf)
    cleaned = apply_cleaning(df, state, keep=("record_id",))
    sc = E.fit_scaler(cleaned, list(C15_COLS))
    return cleaned.select("record_id", *[F.round(e, 6).alias(c) for e, c in zip(E.scale_exprs(sc, list(C15_COLS)), C15_COLS)])


@register("e3_one_hot", records_cte(
    "lv AS (SELECT department AS level, row_number() OVER (ORDER BY count(*) DESC, department) - 1 AS idx FROM records GROUP BY department)") + (
    "SELECT record_id, CAST(idx AS INTEGER) AS hot, (SELECT count(*) FROM lv) AS width FROM records JOIN lv ON records.department = lv.level"))
def e3_one_hot(spark, sf):
    r = records(spark, sf)
    pipe = E.preprocessor([], ["department"]).fit(r)
    out = pipe.transform(r).select("record_id", vector_to_array(F.col("__ohe_department")).alias("v"))
    return out.select("record_id", (F.array_position("v", F.lit(1.0)) - 1).cast("int").alias("hot"), F.size("v").cast("bigint").alias("width"))


@register("e1_backstop", records_cte(f"g AS (SELECT record_id, balance, {GAPPY} AS dept FROM records)") + (
    "SELECT record_id, round(coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM g)), 6) AS balance, "
    "coalesce(dept, (SELECT dept FROM g WHERE dept IS NOT NULL GROUP BY dept ORDER BY count(*) DESC, dept LIMIT 1)) AS dept FROM g"))
def e1_backstop(spark, sf):
    """The median of a numeric and the mode of a categorical column stand in for what is missing."""
    r = records(spark, sf).select("record_id", "balance", F.expr(GAPPY).alias("dept"))
    fills = E.fit_backstop(r, ["balance"], ["dept"])
    out = r.select("record_id", *E.backstop_exprs(fills, ["balance", "dept"]))
    return out.select("record_id", F.round("balance", 6).alias("balance"), "dept")


@register("e4_assemble")
def e4_assemble(spark, sf):
    """Cleaned, derived, scaled columns assembled into one vector per row, with a name for every slot."""
    model = fitted(spark, sf)[0]
    stages = [s for s in model.pipeline.stages if not type(s).__name__.endswith("ClassificationModel")]
    from pyspark.ml import PipelineModel

    out = PipelineModel(stages=stages).transform(model.prepare(records(spark, sf)))
    return out.select(F.col("__input.record_id").alias("record_id"), F.size(vector_to_array(E.FEATURES)).alias("width"),
                      F.lit(len(model.encoded_names)).alias("names"))


@register("sc1_fitted_keeps_inputs", records_cte() + f"SELECT {RECORD_COLS_SQL}, 'note ' || CAST(record_id AS VARCHAR) AS raw_note FROM records")
def sc1_fitted_keeps_inputs(spark, sf):
    """SC1 with a fitted model: the caller's columns come back as they were, also one named like a model's own."""
    model = fitted(spark, sf)[0]
    r = records(spark, sf).withColumn("raw_note", F.concat(F.lit("note "), F.col("record_id").cast("string")))
    return score_frame(r, model.scorer()).select(*r.columns)


# ── S7, M17 ─────────────────────────────────────────────────────────────────
@register("s7_save_load")
def s7_save_load(spark, sf):
    """The fitted chain saved and loaded back scores identically (diff count per row = 0)."""
    model = fitted(spark, sf)[0]
    path = scratch(spark, "model")
    model.save(spark, path)
    again = FittedModel.load(spark, path)
    r = records(spark, sf)
    a = score_frame(r, model.scorer()).select("record_id", F.col("p_approved").alias("before"))
    b = score_frame(r, again.scorer()).select("record_id", F.col("p_approved").alias("after"))
    return a.join(b, "record_id").select("record_id", "before", "after", (F.col("before") != F.col("after")).alias("changed"))


@register("s7_versions", "SELECT * FROM (VALUES (3, 'third', false, true), (2, 'second', true, true), (1, 'first', false, true)) t(place, notes, active, verified)")
def s7_versions(spark, sf):
    """Three versions of the model fitted on `records`, newest first; the second is active again, all files are as saved."""
    model = fitted(spark, sf)[0]
    store = ModelStore(spark, scratch(spark, "store"), FittedModel.load)
    for notes in ("first", "second", "third"):
        store.save(model, notes)
    store.activate(store.names()[1])
    verified = [(v, store.load(v).champion == model.champion) for v in store.names()]
    checked = spark.createDataFrame(verified, "version string, verified boolean")
    listed = store.versions().join(checked, "version")
    return listed.select(F.row_number().over(Window.orderBy("version")).alias("place"), "notes", "active", "verified")


M17_COLS = ("score", "attendance", "projects", "training", "department")
_M17_HASH = "left(md5(CAST(record_id AS VARCHAR) || '|{r}|42'), 13)"


def _m17_sql() -> str:
    """Every shuffled copy in SQL: cyclic shift in hash order (one bucket below 100,000 rows), formula score, rank AUC."""
    digits = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 14), lambda i: (instr('0123456789abcdef', substr(md5(CAST(record_id AS VARCHAR) || '|b|42'), i, 1)) - 1)::BIGINT)), lambda a, x: a * 16 + x)"
    base = f"rec AS (SELECT *, {digits} % CAST(ceil((SELECT count(*) FROM records) / 100000.0) AS BIGINT) AS b FROM records)"
    auc = "(SELECT " + AUC_SQL + " FROM (SELECT outcome, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM ({src})))"
    parts = []
    for c in M17_COLS:
        for r in range(3):
            h = _M17_HASH.format(r=r)
            new = (f"CASE WHEN lead(record_id) OVER w IS NULL THEN first_value({c}) OVER (PARTITION BY b ORDER BY {h}, record_id) ELSE lead({c}) OVER w END AS {c}")
            src = (f"SELECT outcome, {FORMULA2_SQL} AS p FROM (SELECT * REPLACE ({new}) FROM rec WINDOW w AS (PARTITION BY b ORDER BY {h}, record_id))")
            parts.append(f"SELECT '{c}' AS \"column\", {auc.format(src=src)} AS s")
    full = auc.format(src=f"SELECT outcome, {FORMULA2_SQL} AS p FROM rec")
    return records_cte(base) + ("SELECT \"column\", round(avg(f - s), 6) AS importance, round(stddev_pop(f - s), 6) AS importance_std FROM ("
                                + " UNION ALL ".join(parts) + f"), (SELECT {full} AS f) GROUP BY 1")


@register("m17_permutation_importance", _m17_sql())
def m17_permutation_importance(spark, sf):
    """M17 over every record, with the fixed second formula as the model."""
    out = permutation_importance(records(spark, sf), "record_id", formula2_scorer(), list(M17_COLS), "outcome")
    return out.select("column", F.round("importance", 6).alias("importance"), F.round("importance_std", 6).alias("importance_std"))
