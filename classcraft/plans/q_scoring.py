"""Registered queries: batch scoring (SC1–SC7) and explanations (A1–A5)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from classcraft.catalog import register
from classcraft.operators import explain as A
from classcraft.operators import metrics as M
from classcraft.operators import score as SC
from classcraft.operators.clean import auto_rules, fit_cleaning
from classcraft.plans.q_metrics import CURVE_SQL, LABELS, LI, lineitem_probs, scored
from classcraft.operators.schema import input_schema
from classcraft.plans.q_profile import record_plan
from classcraft.session import dealt
from classcraft.sources.tables import FORMULA_SCORE_SQL, records, table

# Fixed second formula for the explanation queries: adds a categorical term so
# categorical levers and attributions have something to find.
FORMULA2_SQL = ("round(1 / (1 + exp(-(0.06 * (score - 50) + 0.5 * projects - 1.25 "
                "+ CASE WHEN training = 'Yes' THEN 0.4 ELSE 0.0 END))), 6)")
RECORD_COLS = ("record_id, score, attendance, aptitude, balance, projects, backlogs, rating, stipend, department, "
               "training, campus, notes, outcome")
THRESH = ", th AS (SELECT min(p) AS t FROM cur WHERE 2 * ctp / (ctp + cfp + n_pos) = (SELECT max(2 * ctp / (ctp + cfp + n_pos)) FROM cur)) "


def np4(x: str) -> str:
    return f"(round_even(({x}) * 10000, 0) / 10000)"


def fitted_scorer(spark, sf) -> SC.Scorer:
    """The formula scorer with its threshold fitted by best F1."""
    t = M.choose_threshold(scored(spark, sf), "best_f1")
    return SC.formula_scorer(t)


def formula2_scorer(threshold: float = 0.5) -> SC.Scorer:
    def transform(df):
        p = F.expr(FORMULA2_SQL)
        return df.withColumn("probs", F.array(p, F.lit(1.0) - p))
    return SC.Scorer(["approved", "rejected"], "approved", threshold, transform)


SCORED_SQL = CURVE_SQL + THRESH + (
    ", sc AS (SELECT r.*, pp / (pp + (1 - pp)) AS pa, (1 - pp) / (pp + (1 - pp)) AS pr_ FROM (SELECT *, "
    f"{FORMULA_SCORE_SQL} AS pp FROM records) r) "
    ", out AS (SELECT " + RECORD_COLS + ", CASE WHEN pa >= (SELECT t FROM th) THEN 'approved' ELSE 'rejected' END AS prediction, "
    f"{np4('pa')} AS p_approved, {np4('pr_')} AS p_rejected, {np4('pa')} AS probability, "
    "CASE WHEN abs(pa - (SELECT t FROM th)) < 0.10 THEN 'Borderline' WHEN abs(pa - (SELECT t FROM th)) >= 0.30 THEN 'High confidence' "
    "ELSE 'Moderate confidence' END AS confidence FROM sc) ")


def scored_records(spark, sf):
    return SC.score_frame(records(spark, sf), fitted_scorer(spark, sf))


@register("sc1_score_table", SCORED_SQL + "SELECT * FROM out")
def sc1_score_table(spark, sf):
    return scored_records(spark, sf)


@register("sc2_binary_label", SCORED_SQL + "SELECT record_id, prediction FROM out")
def sc2_binary_label(spark, sf):
    return scored_records(spark, sf).select("record_id", "prediction")


@register("sc3_multiclass_label", "WITH " + LI + " SELECT l_orderkey, l_linenumber, yhat AS prediction, "
          + np4("list_max(probs)") + " AS probability FROM lp")
def sc3_multiclass_label(spark, sf):
    li = table(spark, sf, "lineitem")
    raw = F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0)
    sc = SC.Scorer(LABELS, None, 0.5, lambda d: d.withColumn("probs", raw))  # renormalised once by the scorer
    out = SC.score_frame(li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), sc)
    return out.select("l_orderkey", "l_linenumber", "prediction", "probability")


@register("sc4_class_columns", SCORED_SQL + "SELECT record_id, p_approved, p_rejected, probability FROM out")
def sc4_class_columns(spark, sf):
    return scored_records(spark, sf).select("record_id", "p_approved", "p_rejected", "probability")


@register("sc5_confidence_band", SCORED_SQL + "SELECT record_id, confidence FROM out")
def sc5_confidence_band(spark, sf):
    return scored_records(spark, sf).select("record_id", "confidence")


@register("sc6_cohort_summary", SCORED_SQL + (
    "SELECT count(*) AS total, " + np4("avg(CASE WHEN prediction = 'approved' THEN 1.0 ELSE 0.0 END)") + " AS positive_rate, "
    + np4("avg(probability)") + " AS mean_probability, count(*) FILTER (WHERE confidence = 'Borderline') AS borderline FROM out"))
def sc6_cohort_summary(spark, sf):
    return SC.cohort_summary(scored_records(spark, sf), "approved")


@register("sc6_label_counts", SCORED_SQL + "SELECT prediction, count(*) AS n FROM out GROUP BY 1")
def sc6_label_counts(spark, sf):
    return SC.label_counts(scored_records(spark, sf))


@register("sc7_probability_histogram", SCORED_SQL + "SELECT CAST(least(floor(probability * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM out GROUP BY 1")
def sc7_probability_histogram(spark, sf):
    return SC.probability_histogram(scored_records(spark, sf))


# ── A1–A5 ───────────────────────────────────────────────────────────────────
NUMERIC = ["score", "attendance", "aptitude", "balance", "projects", "backlogs", "rating"]
CATEGORICAL = ["department", "training"]


def record_fields(spark, sf) -> list[dict]:
    """Input-schema fields (P16) of `records`, as explanation inputs."""
    kept = dealt(records(spark, sf)).persist(StorageLevel.MEMORY_AND_DISK)  # many passes read it
    try:
        df, p, rows, numeric, categorical = record_plan(spark, sf, kept)
        state = fit_cleaning(df, auto_rules(rows, numeric, categorical))
        found = input_schema(df, numeric, categorical, state.kept).collect()
    finally:
        kept.unpersist()
    out = []
    for r in found:
        d = r.asDict()
        if d["kind"] == "categorical":
            d["default"] = d["default_level"]
        out.append(d)
    order = {c: i for i, c in enumerate(NUMERIC + CATEGORICAL)}
    return sorted(out, key=lambda f: order.get(f["name"], 99))


def _f2(score="score", projects="projects", training="training") -> str:
    return (f"round(1 / (1 + exp(-(0.06 * ({score} - 50) + 0.5 * {projects} - 1.25 "
            f"+ CASE WHEN {training} = 'Yes' THEN 0.4 ELSE 0.0 END))), 6)")


DEFAULTS = ("d AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_d" for c in NUMERIC)
            + ", (SELECT v FROM (SELECT department AS v, count(*) AS n FROM records GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS department_d"
            + ", (SELECT v FROM (SELECT training AS v, count(*) AS n FROM records GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS training_d FROM records)")
BASE2 = f"b AS (SELECT *, {_f2()} AS actual FROM records)"


def _a1_branch(i: int, c: str) -> str:
    sub = {"score": "d.score_d", "projects": "CAST(d.projects_d AS INTEGER)", "training": "d.training_d"}
    args = {k: sub[k] if k == c else k for k in ("score", "projects", "training")}
    cf = _f2(**args)
    default = {"projects": "CAST(d.projects_d AS INTEGER)"}.get(c, f"d.{c}_d")
    return (f"SELECT record_id, {i} AS fi, '{c}' AS \"column\", {np4(f'actual - {cf}')} AS delta FROM b, d "
            f"WHERE b.{c} IS NULL OR b.{c} <> {default}")


A1_SQL = (f"WITH records AS ({__import__('classcraft.sources.tables', fromlist=['RECORDS_SQL']).RECORDS_SQL}), {DEFAULTS}, {BASE2}, "
          "cand AS (" + " UNION ALL ".join(_a1_branch(i, c) for i, c in enumerate(NUMERIC + CATEGORICAL)) + ") "
          "SELECT record_id, rank, \"column\", delta FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY abs(delta) DESC, fi) AS rank FROM cand) "
          "WHERE rank <= 3")


@register("a1_attribution", A1_SQL)
def a1_attribution(spark, sf):
    out = A.attribute(records(spark, sf), "record_id", formula2_scorer(), record_fields(spark, sf), top_n=3)
    return out.select("record_id", F.col("rank").cast("bigint").alias("rank"), "column", "delta")


RECS = f"WITH records AS ({__import__('classcraft.sources.tables', fromlist=['RECORDS_SQL']).RECORDS_SQL}) "


@register("a2_what_if_numeric", RECS + (
    ", mm AS (SELECT min(score) AS lo, max(score) AS hi FROM records), "
    "grid AS (SELECT i, " + np4("CASE WHEN i = 24 THEN hi ELSE lo + i * ((hi - lo) / 24.0) END") + " AS v FROM mm, range(0, 25) t(i)), "
    "g2 AS (SELECT v, min(i) AS i FROM grid GROUP BY v), g3 AS (SELECT v, row_number() OVER (ORDER BY i) - 1 AS point FROM g2) "
    f"SELECT record_id, CAST(point AS INTEGER) AS point, v AS value, {_f2(score='v')} AS probability FROM records, g3"))
def a2_what_if_numeric(spark, sf):
    return A.what_if(records(spark, sf), "record_id", formula2_scorer(), record_fields(spark, sf), "score")


@register("a2_what_if_categorical", RECS + (
    ", lv AS (SELECT * FROM (VALUES (0, 'No'), (1, 'Yes')) t(point, v)) "
    f"SELECT record_id, CAST(point AS INTEGER) AS point, v AS value, {_f2(training='v')} AS probability FROM records, lv"))
def a2_what_if_categorical(spark, sf):
    return A.what_if(records(spark, sf), "record_id", formula2_scorer(), record_fields(spark, sf), "training")


LEVERS_SQL = RECS + (
    f", b AS (SELECT record_id, score, projects, training, {_f2()} AS cur FROM records WHERE {_f2()} < 0.5), "
    "mx AS (SELECT max(score) AS hs, max(CAST(projects AS DOUBLE)) AS hp FROM records), steps AS (SELECT i FROM range(1, 25) t(i)), "
    "cs AS (SELECT record_id, i, CASE WHEN i = 24 THEN hs ELSE score + i * ((hs - score) / 24.0) END AS v, score AS now_, projects, training, cur "
    "FROM b, mx, steps WHERE score < hs), "
    f"ls AS (SELECT record_id, 0 AS fi, 'score' AS \"column\", arg_min(v, i) AS to_number, arg_min({_f2(score='v')}, i) AS s, max(now_) AS now_, max(cur) AS cur "
    f"FROM cs WHERE {_f2(score='v')} >= 0.5 GROUP BY record_id), "
    "cp AS (SELECT record_id, i, round_even(CASE WHEN i = 24 THEN hp ELSE CAST(projects AS DOUBLE) + i * ((hp - CAST(projects AS DOUBLE)) / 24.0) END, 0) AS v, "
    "CAST(projects AS DOUBLE) AS now_, score, training, cur FROM b, mx, steps WHERE CAST(projects AS DOUBLE) < hp), "
    f"lp_ AS (SELECT record_id, 4 AS fi, 'projects' AS \"column\", arg_min(v, i) AS to_number, arg_min({_f2(projects='CAST(v AS INTEGER)')}, i) AS s, max(now_) AS now_, max(cur) AS cur "
    f"FROM cp WHERE {_f2(projects='CAST(v AS INTEGER)')} >= 0.5 GROUP BY record_id), "
    f"lt AS (SELECT record_id, 8 AS fi, 'training' AS \"column\", 'Yes' AS to_value, {_f2(training=chr(39) + 'Yes' + chr(39))} AS s, cur FROM b "
    f"WHERE training <> 'Yes' AND {_f2(training=chr(39) + 'Yes' + chr(39))} > cur AND {_f2(training=chr(39) + 'Yes' + chr(39))} >= 0.5), "
    "alll AS (SELECT record_id, fi, \"column\", to_number, " + np4("s - cur") + " AS gain, abs(to_number - now_) AS dist FROM ls "
    "UNION ALL SELECT record_id, fi, \"column\", to_number, " + np4("s - cur") + ", abs(to_number - now_) FROM lp_ "
    "UNION ALL SELECT record_id, fi, \"column\", NULL, " + np4("s - cur") + ", 1e9 FROM lt) ")


def _levers(spark, sf):
    return A.levers(records(spark, sf), "record_id", formula2_scorer(), record_fields(spark, sf))


@register("a3_numeric_levers", LEVERS_SQL + "SELECT record_id, \"column\", to_number, gain FROM alll WHERE fi < 8")
def a3_numeric_levers(spark, sf):
    return _levers(spark, sf).where(F.col("to_number").isNotNull()).select("record_id", "column", "to_number", "gain")


@register("a4_categorical_levers", LEVERS_SQL + "SELECT record_id, \"column\", 'Yes' AS to_value, gain FROM alll WHERE fi = 8")
def a4_categorical_levers(spark, sf):
    return _levers(spark, sf).where(F.col("to_number").isNull()).select("record_id", "column", "to_value", "gain")


@register("a5_lever_ranking", LEVERS_SQL + (
    "SELECT record_id, rank, \"column\", gain FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY dist, fi) AS rank FROM alll) WHERE rank <= 4"))
def a5_lever_ranking(spark, sf):
    return _levers(spark, sf).select("record_id", F.col("rank").cast("bigint").alias("rank"), "column", "gain")
