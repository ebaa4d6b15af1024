"""Registered queries: evaluation (M1–M16) and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from classcraft.catalog import records_cte, register
from classcraft.operators import drift as D
from classcraft.operators import metrics as M
from classcraft.sources.tables import FORMULA_SCORE_SQL, records, table

SCORED = f"s AS (SELECT record_id, CASE WHEN outcome = 'approved' THEN 1 ELSE 0 END AS y, {FORMULA_SCORE_SQL} AS p FROM records)"
LABELS = ["A", "N", "R"]
LI_PROBS_SQL = "[l_quantity / 50.0, l_discount * 10.0, l_tax * 10.0]"
# one row per lineitem: label + renormalised 3-class probabilities
LI = ("li AS (SELECT l_orderkey, l_linenumber, l_returnflag AS y, "
      f"list_transform({LI_PROBS_SQL}, lambda x: x / list_sum({LI_PROBS_SQL})) AS probs FROM lineitem), "
      "lp AS (SELECT *, CASE WHEN probs[1] >= probs[2] AND probs[1] >= probs[3] THEN 'A' WHEN probs[2] >= probs[3] THEN 'N' ELSE 'R' END AS yhat FROM li)")


def scored(spark, sf):
    r = records(spark, sf)
    return r.select("record_id", (F.col("outcome") == "approved").cast("int").alias("y"), F.expr(FORMULA_SCORE_SQL).alias("p"))


def lineitem_probs(spark, sf):
    li = table(spark, sf, "lineitem")
    raw = F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0)
    return li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("y"), M.renormalize(raw).alias("probs"))


def r6(c):
    return F.round(F.col(c), 6).alias(c)


# ── M1–M5 ───────────────────────────────────────────────────────────────────
@register("m1_renormalize", "WITH " + LI.split(", lp AS")[0] + " SELECT l_orderkey, l_linenumber, probs[1] AS p0, probs[2] AS p1, probs[3] AS p2 FROM li")
def m1_renormalize(spark, sf):
    d = lineitem_probs(spark, sf)
    return d.select("l_orderkey", "l_linenumber", *[F.element_at("probs", i + 1).alias(f"p{i}") for i in range(3)])


@register("m2_confusion_binary", records_cte(SCORED) + (
    "SELECT a.actual, a.predicted, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT * FROM (VALUES (0), (1)) t(actual), (VALUES (0), (1)) u(predicted)) a "
    "LEFT JOIN (SELECT y AS actual, CAST(p >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM s GROUP BY 1, 2) c USING (actual, predicted)"))
def m2_confusion_binary(spark, sf):
    return M.confusion_binary(scored(spark, sf), 0.5)


@register("m2_confusion_multiclass", "WITH " + LI + (
    ", g AS (SELECT a AS actual, b AS predicted FROM (VALUES ('A'), ('N'), ('R')) t(a), (VALUES ('A'), ('N'), ('R')) u(b)) "
    "SELECT g.actual, g.predicted, CAST(coalesce(n, 0) AS BIGINT) AS n FROM g LEFT JOIN "
    "(SELECT y AS actual, yhat AS predicted, count(*) AS n FROM lp GROUP BY 1, 2) c USING (actual, predicted)"))
def m2_confusion_multiclass(spark, sf):
    return M.confusion_multiclass(lineitem_probs(spark, sf), LABELS)


BIN_SQL = records_cte(SCORED) + (
    ", c AS (SELECT count(*) AS n, sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS fp, "
    "sum(CASE WHEN p < 0.5 AND y = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN p < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS fn, "
    "avg(pow(p - y, 2)) AS brier, avg(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 2.220446049250313e-16))) AS ll FROM s) ")


@register("m3_binary_metrics", BIN_SQL + (
    "SELECT (tp + tn) / n AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, "
    "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM c"))
def m3_binary_metrics(spark, sf):
    return M.binary_threshold_metrics(scored(spark, sf), 0.5).select("accuracy", "precision", "recall", "f1")


MC_SQL = "WITH " + LI + (
    ", t AS (SELECT y AS label, count(*) AS support, sum(CASE WHEN yhat = y THEN 1 ELSE 0 END) AS tp FROM lp GROUP BY 1), "
    "pr AS (SELECT yhat AS label, count(*) AS predicted FROM lp GROUP BY 1), "
    "per AS (SELECT coalesce(t.label, pr.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted "
    "FROM t FULL OUTER JOIN pr ON t.label = pr.label) ")


@register("m3_multiclass_metrics", MC_SQL + (
    "SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END), 6) AS precision, "
    "round(avg(CASE WHEN support > 0 THEN tp / support ELSE 0.0 END), 6) AS recall, "
    "round(avg(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END), 6) AS f1 FROM per"))
def m3_multiclass_metrics(spark, sf):
    m = M.multiclass_metrics(lineitem_probs(spark, sf), LABELS)
    return m.select(*[r6(c) for c in ("accuracy", "precision", "recall", "f1")])


@register("m4_balanced_accuracy", BIN_SQL + (
    "SELECT (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END) "
    "/ ((CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END)) AS balanced_accuracy FROM c"))
def m4_balanced_accuracy(spark, sf):
    return M.binary_threshold_metrics(scored(spark, sf), 0.5).select("balanced_accuracy")


@register("m4_balanced_accuracy_multiclass", MC_SQL + "SELECT round(avg(tp / support) FILTER (WHERE support > 0), 6) AS balanced_accuracy FROM per")
def m4_balanced_accuracy_multiclass(spark, sf):
    return M.multiclass_metrics(lineitem_probs(spark, sf), LABELS).select(r6("balanced_accuracy"))


@register("m5_rates", BIN_SQL + "SELECT (tp + fp) / n AS positive_rate, (tp + fn) / n AS base_rate FROM c")
def m5_rates(spark, sf):
    return M.binary_threshold_metrics(scored(spark, sf), 0.5).select("positive_rate", "base_rate")


# ── M6–M14 (curves) ─────────────────────────────────────────────────────────
CURVE_SQL = records_cte(SCORED) + (
    ", g AS (SELECT p, sum(y) AS tp, sum(1 - y) AS fp FROM s GROUP BY p), "
    "cur AS (SELECT p, tp, fp, sum(tp) OVER (ORDER BY p DESC) AS ctp, sum(fp) OVER (ORDER BY p DESC) AS cfp, "
    "(SELECT sum(tp) FROM g) AS n_pos, (SELECT sum(fp) FROM g) AS n_neg FROM g) ")


def curve(spark, sf):
    return M.score_curve(scored(spark, sf))


@register("m6_roc_auc", CURVE_SQL + "SELECT round(sum(fp * ((ctp - tp) + tp / 2.0)) / (max(n_pos) * max(n_neg)), 9) AS roc_auc FROM cur")
def m6_roc_auc(spark, sf):
    return M.auc_from_curve(curve(spark, sf)).select(F.round("roc_auc", 9).alias("roc_auc"))


def _ovr_sql() -> str:
    parts = []
    for i, lab in enumerate(LABELS):
        parts.append(
            f"SELECT {i} AS ci, p, sum(y) AS tp, sum(1 - y) AS fp FROM (SELECT probs[{i + 1}] AS p, CASE WHEN y = '{lab}' THEN 1 ELSE 0 END AS y FROM li) GROUP BY p")
    return ("WITH " + LI.split(", lp AS")[0] + ", g AS (" + " UNION ALL ".join(parts) + "), "
            "cur AS (SELECT ci, p, tp, fp, sum(tp) OVER (PARTITION BY ci ORDER BY p DESC) AS ctp, "
            "sum(tp) OVER (PARTITION BY ci) AS n_pos, sum(fp) OVER (PARTITION BY ci) AS n_neg FROM g), "
            "auc AS (SELECT ci, sum(fp * ((ctp - tp) + tp / 2.0)) / (max(n_pos) * max(n_neg)) AS a FROM cur GROUP BY ci) "
            "SELECT CASE WHEN (SELECT count(DISTINCT y) FROM li) = 3 THEN round(avg(a), 6) END AS roc_auc FROM auc")


@register("m7_ovr_auc", _ovr_sql())
def m7_ovr_auc(spark, sf):
    return M.ovr_auc(lineitem_probs(spark, sf), LABELS).select(r6("roc_auc"))


@register("m8_average_precision", CURVE_SQL + "SELECT round(sum(tp / n_pos * (ctp / (ctp + cfp))), 6) AS average_precision FROM cur")
def m8_average_precision(spark, sf):
    return M.average_precision_from_curve(curve(spark, sf)).select(r6("average_precision"))


@register("m9_brier", BIN_SQL + "SELECT round(brier, 6) AS brier_score FROM c")
def m9_brier(spark, sf):
    return M.binary_threshold_metrics(scored(spark, sf), 0.5).select(r6("brier_score"))


@register("m10_log_loss", BIN_SQL + "SELECT round(ll, 6) AS log_loss FROM c")
def m10_log_loss(spark, sf):
    return M.binary_threshold_metrics(scored(spark, sf), 0.5).select(r6("log_loss"))


@register("m10_log_loss_multiclass", "WITH " + LI.split(", lp AS")[0] + (
    " SELECT round(avg(-ln(greatest(probs[CASE y WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END], 2.220446049250313e-16))), 6) AS log_loss FROM li"))
def m10_log_loss_multiclass(spark, sf):
    return M.multiclass_log_loss(lineitem_probs(spark, sf), LABELS).select(r6("log_loss"))


THIN = ("CASE WHEN m <= 200 THEN TRUE ELSE list_contains(list_transform(range(0, 200), lambda i: CASE WHEN i = 199 THEN m - 1 "
        "ELSE CAST(floor(i * ((m - 1) / 199.0)) AS BIGINT) END), idx) END")
POINT = ("CASE WHEN m <= 200 THEN idx ELSE list_position(list_transform(range(0, 200), lambda i: CASE WHEN i = 199 THEN m - 1 "
         "ELSE CAST(floor(i * ((m - 1) / 199.0)) AS BIGINT) END), idx) - 1 END")


@register("m11_roc_points", CURVE_SQL + (
    ", r AS (SELECT *, row_number() OVER (ORDER BY p DESC) - 1 AS idx, count(*) OVER () AS n_pts, "
    "lead(tp) OVER (ORDER BY p DESC) AS tp_next, lead(fp) OVER (ORDER BY p DESC) AS fp_next FROM cur), "
    "kept AS (SELECT p, ctp, cfp, n_pos, n_neg FROM r WHERE idx = 0 OR idx = n_pts - 1 OR fp_next <> fp OR tp_next <> tp "
    "UNION ALL SELECT 2.0, 0, 0, (SELECT max(n_pos) FROM cur), (SELECT max(n_neg) FROM cur)), "
    "k2 AS (SELECT *, row_number() OVER (ORDER BY p DESC) - 1 AS idx, count(*) OVER () AS m FROM kept) "
    f"SELECT CAST({POINT} AS INTEGER) AS point, round_even(cfp / n_neg * 100000, 0) / 100000 AS fpr, round_even(ctp / n_pos * 100000, 0) / 100000 AS tpr FROM k2 WHERE {THIN}"))
def m11_roc_points(spark, sf):
    return M.roc_points(curve(spark, sf))


@register("m12_pr_points", CURVE_SQL + (
    ", r AS (SELECT row_number() OVER (ORDER BY p) - 1 AS idx, ctp / (ctp + cfp) AS precision, ctp / n_pos AS recall, count(*) OVER () + 1 AS m FROM cur), "
    "allp AS (SELECT * FROM r UNION ALL SELECT max(m) - 1, 1.0, 0.0, max(m) FROM r) "
    f"SELECT CAST({POINT} AS INTEGER) AS point, round_even(precision * 100000, 0) / 100000 AS precision, round_even(recall * 100000, 0) / 100000 AS recall FROM allp WHERE {THIN}"))
def m12_pr_points(spark, sf):
    return M.pr_points(curve(spark, sf))


@register("m13_best_f1_threshold", CURVE_SQL + (
    "SELECT CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN arg_max(p, 2 * ctp / (ctp + cfp + n_pos) * 1e9 - p) END AS threshold FROM ("
    "SELECT p, ctp, cfp, n_pos, n_neg FROM cur) WHERE 2 * ctp / (ctp + cfp + n_pos) = (SELECT max(2 * ctp / (ctp + cfp + n_pos)) FROM cur)"))
def m13_best_f1_threshold(spark, sf):
    return M.best_f1_threshold(curve(spark, sf))


@register("m14_best_youden_threshold", CURVE_SQL + (
    "SELECT CASE WHEN max(j) > 0 THEN max(p) FILTER (WHERE j = (SELECT max(ctp / n_pos - cfp / n_neg) FROM cur)) ELSE 0.5 END AS threshold "
    "FROM (SELECT p, ctp / n_pos - cfp / n_neg AS j FROM cur)"))
def m14_best_youden_threshold(spark, sf):
    return M.best_youden_threshold(curve(spark, sf))


@register("m15_threshold_strategies", CURVE_SQL + (
    ", f AS (SELECT min(p) AS t FROM cur WHERE 2 * ctp / (ctp + cfp + n_pos) = (SELECT max(2 * ctp / (ctp + cfp + n_pos)) FROM cur)), "
    "yj AS (SELECT max(p) AS t FROM cur WHERE ctp / n_pos - cfp / n_neg = (SELECT max(ctp / n_pos - cfp / n_neg) FROM cur)) "
    "SELECT 'default' AS strategy, 0.5 AS threshold UNION ALL SELECT 'best_f1', t FROM f UNION ALL SELECT 'best_youden', t FROM yj"))
def m15_threshold_strategies(spark, sf):
    d = scored(spark, sf)
    rows = [(s, M.choose_threshold(d, s)) for s in ("default", "best_f1", "best_youden")]
    return spark.createDataFrame(rows, "strategy string, threshold double")


@register("m16_primary_metric", BIN_SQL + (
    ", g AS (SELECT p, sum(y) AS tp, sum(1 - y) AS fp FROM s GROUP BY p), "
    "cur AS (SELECT p, tp, fp, sum(tp) OVER (ORDER BY p DESC) AS ctp, (SELECT sum(tp) FROM g) AS n_pos, (SELECT sum(fp) FROM g) AS n_neg FROM g) "
    ", auc AS (SELECT sum(fp * ((ctp - tp) + tp / 2.0)) / (max(n_pos) * max(n_neg)) AS roc_auc FROM cur) "
    "SELECT 'roc_auc' AS metric, round((SELECT roc_auc FROM auc), 9) AS value "
    "UNION ALL SELECT 'f1', round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 9) FROM c "
    "UNION ALL SELECT 'no_such_metric', round((SELECT roc_auc FROM auc), 9)"))
def m16_primary_metric(spark, sf):
    d = scored(spark, sf)
    report = M.binary_report(d, 0.5)
    out = None
    for m in ("roc_auc", "f1", "no_such_metric"):
        row = report.select(F.lit(m).alias("metric"), F.round(M.primary_score(report, m), 9).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


# ── D1–D8 ───────────────────────────────────────────────────────────────────
NUMERIC = ["score", "attendance", "aptitude", "balance", "projects", "backlogs", "rating"]
RECENT_SQL = ("recent AS (SELECT record_id, score * 0.4 AS score, attendance, aptitude, balance, projects, backlogs, rating, "
              "CASE WHEN training = 'Yes' THEN '1-URGENT' ELSE department END AS department, training FROM records)")


def recent(spark, sf):
    r = records(spark, sf)
    return r.withColumn("score", F.col("score") * 0.4).withColumn(
        "department", F.when(F.col("training") == "Yes", F.lit("1-URGENT")).otherwise(F.col("department")))


def _edges_sql(src: str, cols: list[str]) -> str:
    qs = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), {qs}))) AS edges FROM {src}" for c in cols)


def _long_sql(src: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM {src} WHERE {c} IS NOT NULL" for c in cols)


def _shares_sql(long: str, edges: str) -> str:
    """(column, bin, share) over ``edges`` (all bins)."""
    return (f"(SELECT b.\"column\", b.bin, coalesce(n, 0) / tot.total AS share FROM "
            f"(SELECT \"column\", unnest(range(0, len(edges) - 1)) AS bin FROM {edges}) b "
            f"LEFT JOIN (SELECT l.\"column\", len(list_filter(edges[2:len(edges) - 1], lambda e: e <= v)) AS bin, count(*) AS n "
            f"FROM {long} l JOIN {edges} USING (\"column\") GROUP BY 1, 2) c USING (\"column\", bin) "
            f"JOIN (SELECT \"column\", count(*) AS total FROM {long} GROUP BY 1) tot USING (\"column\"))")


D1_CTE = records_cte(
    f"ed AS ({_edges_sql('records', NUMERIC)})",
    f"lg AS ({_long_sql('records', NUMERIC)})",
    f"sh AS {_shares_sql('lg', 'ed')}")


@register("d1_numeric_baseline", D1_CTE + (
    "SELECT \"column\", bin, round(share, 6) AS share, round(edges[bin + 1], 6) AS lower_edge FROM sh JOIN ed USING (\"column\")"))
def d1_numeric_baseline(spark, sf):
    b = D.numeric_baseline(records(spark, sf), NUMERIC)
    return b.select("column", F.posexplode("shares").alias("bin", "share"), "edges").select(
        "column", "bin", "share", F.element_at("edges", F.col("bin") + 1).alias("lower_edge"))


LV = ("lv AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS level, count(*) AS n FROM records WHERE {c} IS NOT NULL GROUP BY 2"
                                     for c in ("department", "training")) + ")")
TOT = "tot AS (SELECT \"column\", sum(n) AS total FROM lv GROUP BY 1)"
BASE = ("base AS (SELECT \"column\", level, round(n / total, 6) AS share FROM (SELECT lv.*, total, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, level) AS rk "
        "FROM lv JOIN tot USING (\"column\")) WHERE rk <= 50)")
D2_SQL = records_cte(LV, TOT)


@register("d2_categorical_baseline", D2_SQL + (
    "SELECT \"column\", level, round(n / total, 6) AS share FROM (SELECT lv.*, total, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, level) AS rk "
    "FROM lv JOIN tot USING (\"column\")) WHERE rk <= 50"))
def d2_categorical_baseline(spark, sf):
    return D.categorical_baseline(records(spark, sf), ["department", "training"], top=50)


PSI = "(greatest(coalesce({n}, 0.0), 1e-6) - greatest(coalesce({b}, 0.0), 1e-6)) * ln(greatest(coalesce({n}, 0.0), 1e-6) / greatest(coalesce({b}, 0.0), 1e-6))"


@register("d3_psi_numeric", records_cte(
    RECENT_SQL,
    f"ed AS ({_edges_sql('records', ['score', 'attendance'])})",
    f"lb AS ({_long_sql('records', ['score', 'attendance'])})",
    f"ln_ AS ({_long_sql('recent', ['score', 'attendance'])})",
    f"sb AS {_shares_sql('lb', 'ed')}",
    f"sn AS {_shares_sql('ln_', 'ed')}") + (
    f"SELECT sb.\"column\", round(sum({PSI.format(n='sn.share', b='sb.share')}), 6) AS psi FROM sb JOIN sn USING (\"column\", bin) GROUP BY 1"))
def d3_psi_numeric(spark, sf):
    p = D.psi_numeric(records(spark, sf), recent(spark, sf), ["score", "attendance"])
    return p.select("column", r6("psi"))


def _level_sql(src: str, cols: list[str], name: str) -> str:
    return (f"{name} AS (SELECT x.\"column\", level, n / total AS share FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS level, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY 2" for c in cols)
        + f") x JOIN (SELECT \"column\", sum(n) AS total FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n FROM {src}" for c in cols) + ") GROUP BY 1) t USING (\"column\"))")


@register("d4_psi_categorical", records_cte(RECENT_SQL, _level_sql("records", ["department", "training"], "lb"),
                                            _level_sql("recent", ["department", "training"], "lr")) + (
    f"SELECT coalesce(lb.\"column\", lr.\"column\") AS \"column\", round(sum({PSI.format(n='lr.share', b='lb.share')}), 6) AS psi "
    "FROM lb FULL OUTER JOIN lr ON lb.\"column\" = lr.\"column\" AND lb.level = lr.level GROUP BY 1"))
def d4_psi_categorical(spark, sf):
    return D.psi_categorical(records(spark, sf), recent(spark, sf), ["department", "training"]).select("column", r6("psi"))


@register("d5_psi_from_shares", records_cte(LV, TOT, BASE, RECENT_SQL, _level_sql("recent", ["department", "training"], "lr")) + (
    f"SELECT coalesce(base.\"column\", lr.\"column\") AS \"column\", round(sum({PSI.format(n='lr.share', b='base.share')}), 6) AS psi "
    "FROM base FULL OUTER JOIN lr ON base.\"column\" = lr.\"column\" AND base.level = lr.level GROUP BY 1"))
def d5_psi_from_shares(spark, sf):
    base = D.categorical_baseline(records(spark, sf), ["department", "training"], top=50)
    return D.psi_from_shares(recent(spark, sf), base).select("column", r6("psi"))


D1_PARTS = [f"ed AS ({_edges_sql('records', NUMERIC)})", f"lg AS ({_long_sql('records', NUMERIC)})", f"sh AS {_shares_sql('lg', 'ed')}"]
D6_PARTS = D1_PARTS + [
    RECENT_SQL,
    "st AS (SELECT \"column\", list_transform(edges, lambda e: round(e, 6)) AS edges FROM ed)",
    f"lr AS ({_long_sql('recent', NUMERIC)})",
    f"sr AS {_shares_sql('lr', 'st')}",
    "psi AS (SELECT sh.\"column\", sum(" + PSI.format(n="sr.share", b="round(sh.share, 6)") + ") AS psi FROM sh JOIN sr USING (\"column\", bin) GROUP BY 1)",
]
D6_CTE = records_cte(*D6_PARTS)


@register("d6_psi_from_edges", D6_CTE + "SELECT \"column\", round(psi, 6) AS psi FROM psi")
def d6_psi_from_edges(spark, sf):
    base = D.numeric_baseline(records(spark, sf), NUMERIC)
    return D.psi_from_edges(recent(spark, sf), base).select("column", r6("psi"))


@register("d7_status", D6_CTE + "SELECT \"column\", CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.10 THEN 'watch' ELSE 'ok' END AS status FROM psi")
def d7_status(spark, sf):
    base = D.numeric_baseline(records(spark, sf), NUMERIC)
    p = D.psi_from_edges(recent(spark, sf), base)
    return p.select("column", D.status(F.col("psi")).alias("status"))


STATUS = "CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.10 THEN 'watch' ELSE 'ok' END"


@register("d8_drift_report", records_cte(*D6_PARTS, LV, TOT, BASE, _level_sql("recent", ["department", "training"], "lr2"),
    f"cat AS (SELECT coalesce(base.\"column\", lr2.\"column\") AS \"column\", sum({PSI.format(n='lr2.share', b='base.share')}) AS psi "
    "FROM base FULL OUTER JOIN lr2 ON base.\"column\" = lr2.\"column\" AND base.level = lr2.level GROUP BY 1)",
    "allp AS (SELECT * FROM psi UNION ALL SELECT * FROM cat)") + (
    f"SELECT \"column\", round(psi, 4) AS psi, {STATUS} AS status, "
    f"(SELECT {STATUS} FROM allp ORDER BY round(psi, 4) DESC LIMIT 1) AS overall, "
    "(SELECT count(*) FROM recent) AS n_recent FROM allp"))
def d8_drift_report(spark, sf):
    r = records(spark, sf)
    nb = D.numeric_baseline(r, NUMERIC)
    cb = D.categorical_baseline(r, ["department", "training"], top=50)
    return D.drift_report(recent(spark, sf), nb, cb)


# ── drift with empty sides ──────────────────────────────────────────────────
@register("d3_d6_empty_sides", "SELECT * FROM (VALUES ('d3', 'score', 0.0), ('d3', 'attendance', 0.0), ('d4', 'training', 0.0), ('d5', 'training', 0.0), "
          "('d6', 'score', 0.0), ('d6', 'rating', 0.0)) AS t(op, \"column\", psi)")
def d3_d6_empty_sides(spark, sf):
    """D3–D6 where the recent sample has rows but no values: 0.0 for every column, no alert."""
    r = records(spark, sf)
    empty = r.withColumns({c: F.lit(None).cast(t) for c, t in (("score", "double"), ("attendance", "double"), ("rating", "double"), ("training", "string"))})
    parts = {"d3": D.psi_numeric(r, empty, ["score", "attendance"]), "d4": D.psi_categorical(r, empty, ["training"]),
             "d5": D.psi_from_shares(empty, D.categorical_baseline(r, ["training"])), "d6": D.psi_from_edges(empty, D.numeric_baseline(r, ["score", "rating"]))}
    rows = [p.select(F.lit(name).alias("op"), "column", "psi") for name, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@register("d8_drift_all_null_column", records_cte() + "SELECT 'projects' AS \"column\", 0.0 AS psi, 'ok' AS status, 'ok' AS overall, (SELECT count(*) FROM records) AS n_recent")
def d8_drift_all_null_column(spark, sf):
    """A column without recent values and a column the table lacks are not compared; the others are."""
    r = records(spark, sf)
    base = D.numeric_baseline(r, ["score", "projects", "rating"])
    return D.drift_report(r.withColumn("score", F.lit(None).cast("double")).drop("rating"), base, None)


# ── curves over a narrow range of scores ────────────────────────────────────
NARROW = f"({FORMULA_SCORE_SQL}) / 2000.0 + 0.5"


@register("m6_narrow_scores", records_cte() + (
    "SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc, "
    "count(DISTINCT p) AS n_scores FROM (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM "
    f"(SELECT CASE WHEN outcome = 'approved' THEN 1 ELSE 0 END AS y, {NARROW} AS p FROM records))"))
def m6_narrow_scores(spark, sf):
    """M6 where all scores lie within 0.0005 of each other: the curve's ranges still hold a bounded share each."""
    r = records(spark, sf).select((F.col("outcome") == "approved").cast("int").alias("y"), F.expr(NARROW).alias("p"))
    curve = M.score_curve(r)
    return M.auc_from_curve(curve).select(F.round("roc_auc", 6).alias("roc_auc"), F.lit(curve.count()).cast("bigint").alias("n_scores"))
