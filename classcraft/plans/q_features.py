"""Registered queries: learned cleaning (C1–C15) and derived features."""

from __future__ import annotations

from pyspark.sql import functions as F

from classcraft.catalog import records_cte, register
from classcraft.functions.features import FeatureSpec, apply_features, fit_features
from classcraft.operators import profile as prof
from classcraft.operators.clean import CleanRule, apply_cleaning, auto_rules, fit_cleaning
from classcraft.operators.synth import auto_features, validate_features
from classcraft.plans.q_profile import NUM_RE, WS, record_plan
from classcraft.sources.tables import records

GAPPY = "CASE WHEN balance IS NULL THEN NULL ELSE department END"


def _gappy(spark, sf):
    r = records(spark, sf)
    return r.withColumn("dept_gappy", F.expr(GAPPY))


def _clean(df, rules, keep=("record_id",)):
    state = fit_cleaning(df, rules)
    return apply_cleaning(df, state, keep=keep)


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def sql_ws(c: str) -> str:
    return f"regexp_replace({c}, {WS})"


def sql_parse(c: str) -> str:
    t = sql_ws(f"CAST({c} AS VARCHAR)")
    return f"CASE WHEN regexp_matches({t}, {NUM_RE}) THEN TRY_CAST({t} AS DOUBLE) END"


# ── C1–C15 ──────────────────────────────────────────────────────────────────
_C1 = f"replace(replace({sql_ws('stipend')}, ',', ''), '%', '')"


@register("c1_coerce_numeric", records_cte() + (
    f"SELECT record_id, coalesce(CASE WHEN regexp_matches({_C1}, {NUM_RE}) THEN TRY_CAST({_C1} AS DOUBLE) END, "
    f"(SELECT quantile_cont(CASE WHEN regexp_matches({_C1}, {NUM_RE}) THEN TRY_CAST({_C1} AS DOUBLE) END, 0.5) FROM records), 0.0) AS stipend, "
    f"CASE WHEN CASE WHEN regexp_matches({_C1}, {NUM_RE}) THEN TRY_CAST({_C1} AS DOUBLE) END IS NULL THEN 1.0 ELSE 0.0 END AS __missing__stipend FROM records"))
def c1_coerce_numeric(spark, sf):
    return _clean(records(spark, sf), [CleanRule("stipend", coerce_numeric=True)])


@register("c2_strip_whitespace", records_cte() + (
    f"SELECT record_id, coalesce({sql_ws('department')}, (SELECT mode_v FROM (SELECT department AS mode_v, count(*) AS n FROM records WHERE department IS NOT NULL GROUP BY 1 ORDER BY n DESC, mode_v LIMIT 1)), 'Other') AS department, "
    "CASE WHEN department IS NULL THEN 1.0 ELSE 0.0 END AS __missing__department FROM records"))
def c2_strip_whitespace(spark, sf):
    return _clean(records(spark, sf), [CleanRule("department", strip_whitespace=True, impute="most_frequent")])


@register("c3_lowercase", records_cte() + (
    "SELECT record_id, coalesce(lower(department), 'Other') AS department, "
    "CASE WHEN department IS NULL THEN 1.0 ELSE 0.0 END AS __missing__department FROM records"))
def c3_lowercase(spark, sf):
    return _clean(records(spark, sf), [CleanRule("department", lowercase=True, impute="none")])


@register("c4_missing_flag", records_cte() + (
    "SELECT record_id, coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM records), 0.0) AS balance, "
    "CASE WHEN balance IS NULL THEN 1.0 ELSE 0.0 END AS __missing__balance FROM records"))
def c4_missing_flag(spark, sf):
    return _clean(records(spark, sf), [CleanRule("balance")])


@register("c5_impute_median", records_cte() + (
    "SELECT record_id, round(coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM records)), 6) AS balance FROM records"))
def c5_impute_median(spark, sf):
    out = _clean(records(spark, sf), [CleanRule("balance", impute="median")])
    return out.select("record_id", r6("balance"))


@register("c6_impute_mean", records_cte() + (
    "SELECT record_id, round(coalesce(balance, (SELECT avg(balance) FROM records)), 6) AS balance FROM records"))
def c6_impute_mean(spark, sf):
    out = _clean(records(spark, sf), [CleanRule("balance", impute="mean")])
    return out.select("record_id", r6("balance"))


@register("c7_impute_most_frequent", records_cte() + (
    f"SELECT record_id, coalesce({GAPPY}, (SELECT v FROM (SELECT {GAPPY} AS v, count(*) AS n FROM records WHERE {GAPPY} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)) AS dept_gappy, "
    "coalesce(balance, (SELECT v FROM (SELECT balance AS v, count(*) AS n FROM records WHERE balance IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)) AS balance FROM records"))
def c7_impute_most_frequent(spark, sf):
    out = _clean(_gappy(spark, sf), [CleanRule("dept_gappy", impute="most_frequent"), CleanRule("balance", impute="most_frequent")])
    return out.select("record_id", "dept_gappy", "balance")


@register("c8_impute_constant", records_cte() + "SELECT record_id, coalesce(balance, -1.0) AS balance FROM records")
def c8_impute_constant(spark, sf):
    out = _clean(records(spark, sf), [CleanRule("balance", impute="constant", fill_value=-1.0)])
    return out.select("record_id", "balance")


@register("c9_impute_none", records_cte() + (
    f"SELECT record_id, coalesce(balance, 0.0) AS balance, coalesce({GAPPY}, 'Other') AS dept_gappy FROM records"))
def c9_impute_none(spark, sf):
    out = _clean(_gappy(spark, sf), [CleanRule("balance", impute="none"), CleanRule("dept_gappy", impute="none")])
    return out.select("record_id", "balance", "dept_gappy")


@register("c10_clip", records_cte() + (
    "SELECT record_id, round(least(greatest(coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM records)), 0.0), 5000.0), 6) AS balance FROM records"))
def c10_clip(spark, sf):
    out = _clean(records(spark, sf), [CleanRule("balance", clip_min=0.0, clip_max=5000.0)])
    return out.select("record_id", r6("balance"))


_KEPT = (f"kept AS (SELECT level FROM (SELECT {sql_ws('department')} AS level, count(*) AS n FROM records WHERE department IS NOT NULL GROUP BY 1) "
         "WHERE n / (SELECT count(department) FROM records) >= {f})")


@register("c11_fold_rare_levels", records_cte(_KEPT.format(f=0.05)) + (
    "SELECT record_id, CASE WHEN coalesce(department, 'Other') IN (SELECT level FROM kept) THEN coalesce(department, 'Other') ELSE 'Other' END AS department FROM records"))
def c11_fold_rare_levels(spark, sf):
    out = _clean(records(spark, sf), [CleanRule("department", impute="none", rare_min_frequency=0.05)])
    return out.select("record_id", "department")


@register("c12_unseen_level", records_cte(
    f"train AS (SELECT * FROM records WHERE {sql_ws('department')} <> 'RARE')",
    f"kept AS (SELECT level FROM (SELECT {sql_ws('department')} AS level, count(*) AS n FROM train WHERE department IS NOT NULL GROUP BY 1) "
    "WHERE n / (SELECT count(department) FROM train) >= 0.001)") + (
    f"SELECT record_id, CASE WHEN {sql_ws('department')} IN (SELECT level FROM kept) THEN {sql_ws('department')} ELSE 'Other' END AS department FROM records"))
def c12_unseen_level(spark, sf):
    r = records(spark, sf)
    rule = CleanRule("department", strip_whitespace=True, impute="none", rare_min_frequency=0.001)
    state = fit_cleaning(r.where(F.regexp_replace("department", r"^\s+|\s+$", "") != "RARE"), [rule])
    return apply_cleaning(r, state, keep=("record_id",)).select("record_id", "department")


@register("c13_absent_column", records_cte() + (
    "SELECT record_id, (SELECT quantile_cont(attendance, 0.5) FROM records) AS attendance, 1.0 AS __missing__attendance FROM records"))
def c13_absent_column(spark, sf):
    r = records(spark, sf)
    state = fit_cleaning(r, [CleanRule("attendance")])
    return apply_cleaning(r.drop("attendance"), state, keep=("record_id",))


@register("c14_residual_nulls", records_cte() + (
    f"SELECT record_id, coalesce(CASE WHEN balance IS NOT NULL THEN least(greatest(balance, 100.0), 200.0) END, 0.0) AS balance, "
    f"coalesce({GAPPY}, 'Other') AS dept_gappy, CASE WHEN balance IS NULL THEN 1.0 ELSE 0.0 END AS __missing__balance, "
    f"CASE WHEN {GAPPY} IS NULL THEN 1.0 ELSE 0.0 END AS __missing__dept_gappy FROM records"))
def c14_residual_nulls(spark, sf):
    """C14: without a fill, clipping leaves a NULL alone and the final step makes it 0.0 / 'Other'."""
    rules = [CleanRule("balance", impute="none", clip_min=100.0, clip_max=200.0), CleanRule("dept_gappy", impute="none")]
    return _clean(_gappy(spark, sf), rules)


def _auto_clean(spark, sf):
    df, p, rows, numeric, categorical = record_plan(spark, sf)
    rules = auto_rules(rows, numeric, categorical)
    state = fit_cleaning(df, rules)
    return df, rows, numeric, categorical, state


C15_COLS = ("score", "attendance", "aptitude", "balance", "projects", "backlogs", "rating")


@register("c15_auto_cleaning", records_cte(_KEPT.format(f=0.01).replace("{f}", "0.01")) + (
    "SELECT record_id, " + ", ".join(
        f"round(coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM records), 0.0), 6) AS {c}" for c in C15_COLS)
    + f", CASE WHEN coalesce({sql_ws('department')}, (SELECT v FROM (SELECT department AS v, count(*) AS n FROM records GROUP BY 1) ORDER BY n DESC, v LIMIT 1)) IN (SELECT level FROM kept) "
    f"THEN coalesce({sql_ws('department')}, 'Other') ELSE 'Other' END AS department, training, "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END AS __missing__{c}" for c in (*C15_COLS, "department", "training"))
    + " FROM records"))
def c15_auto_cleaning(spark, sf):
    df, rows, numeric, categorical, state = _auto_clean(spark, sf)
    out = apply_cleaning(df, state, keep=("record_id",))
    return out.select("record_id", *[r6(c) for c in C15_COLS], "department", "training",
                      *[f"__missing__{c}" for c in (*C15_COLS, "department", "training")])


# ── X01–X24 ─────────────────────────────────────────────────────────────────
def nsql(c: str, text: bool = False) -> str:
    return f"coalesce({sql_parse(c)}, 0.0)" if text else f"coalesce(CAST({c} AS DOUBLE), 0.0)"


def fin(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE ({x}) END)"


def sdiv(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"


DEPT_TXT = sql_ws("coalesce(CAST(department AS VARCHAR), '')")
S, A, AP, B = nsql("score"), nsql("attendance"), nsql("aptitude"), nsql("balance")
PJ, BL, RT, ST = nsql("projects"), nsql("backlogs"), nsql("rating"), nsql("stipend", True)

X_CASES = {
    "x01_sum": (FeatureSpec.of("f", "sum", ["score", "balance", "stipend"]), fin(f"{S} + {B} + {ST}")),
    "x02_mean": (FeatureSpec.of("f", "mean", ["attendance", "aptitude", "score"]), fin(f"({A} + {AP} + {S}) / 3.0")),
    "x03_weighted_sum": (FeatureSpec.of("f", "weighted_sum", ["score", "projects"], weights=[2, 0.5]), fin(f"{S} * 2.0 + {PJ} * 0.5")),
    "x04_product": (FeatureSpec.of("f", "product", ["rating", "projects"]), fin(f"{RT} * {PJ}")),
    "x05_difference": (FeatureSpec.of("f", "difference", ["attendance", "aptitude"]), fin(f"{A} - {AP}")),
    "x06_abs_difference": (FeatureSpec.of("f", "abs_difference", ["attendance", "aptitude"]), fin(f"abs({A} - {AP})")),
    "x07_ratio": (FeatureSpec.of("f", "ratio", ["score", "backlogs"]), sdiv(S, BL)),
    "x08_per_unit": (FeatureSpec.of("f", "per_unit", ["score", "backlogs"]), sdiv(S, f"{BL} + 1.0")),
    "x09_spread": (FeatureSpec.of("f", "spread", ["aptitude", "attendance", "score"]), fin(f"greatest({AP}, {A}, {S}) - least({AP}, {A}, {S})")),
    "x10_rowwise_max": (FeatureSpec.of("f", "rowwise_max", ["aptitude", "attendance", "score", "balance"]), fin(f"greatest({AP}, {A}, {S}, {B})")),
    "x11_rowwise_min": (FeatureSpec.of("f", "rowwise_min", ["aptitude", "attendance", "score", "balance"]), fin(f"least({AP}, {A}, {S}, {B})")),
    "x12_count_above": (FeatureSpec.of("f", "count_above", ["aptitude", "attendance", "score"], threshold=50),
                        fin(f"CAST({AP} >= 50.0 AS DOUBLE) + CAST({A} >= 50.0 AS DOUBLE) + CAST({S} >= 50.0 AS DOUBLE)")),
    "x13_scale": (FeatureSpec.of("f", "scale", ["score"], factor=20), fin(f"{S} * 20.0")),
    "x14_offset": (FeatureSpec.of("f", "offset", ["balance"], offset=5), fin(f"{B} + 5.0")),
    "x15_clip": (FeatureSpec.of("f", "clip", ["rating"], min=2, max=3), fin(f"least(greatest({RT}, 2.0), 3.0)")),
    "x16_log1p": (FeatureSpec.of("f", "log1p", ["balance"]), fin(f"ln(1 + greatest({B}, -0.999999))")),
    "x17_sqrt": (FeatureSpec.of("f", "sqrt", ["balance"]), fin(f"sqrt(greatest({B}, 0.0))")),
    "x18_binarize_threshold": (FeatureSpec.of("f", "binarize_threshold", ["score"], threshold=50), f"CAST({S} >= 50.0 AS DOUBLE)"),
    "x19_binarize_equals": (FeatureSpec.of("f", "binarize_equals", ["department"], value=" 1-URGENT"),
                            f"CAST({DEPT_TXT} = '1-URGENT' AS DOUBLE)"),
    "x20_category_map": (FeatureSpec.of("f", "category_map", ["department"], mapping={"1-URGENT": 0, "2-HIGH": 2}, default=-1),
                         f"CASE {DEPT_TXT} WHEN '1-URGENT' THEN 0.0 WHEN '2-HIGH' THEN 2.0 ELSE -1.0 END"),
    "x21_is_missing": (FeatureSpec.of("f", "is_missing", ["balance"]), "CASE WHEN balance IS NULL THEN 1.0 ELSE 0.0 END"),
    "x22_normalize_max": (FeatureSpec.of("f", "normalize_max", ["projects"]), fin(f"{PJ} / (SELECT max({PJ}) FROM records)")),
    "x23_min_max_scale": (FeatureSpec.of("f", "min_max_scale", ["balance"]),
                          fin(f"({B} - (SELECT min({B}) FROM records)) / ((SELECT max({B}) FROM records) - (SELECT min({B}) FROM records))")),
    "x24_zscore": (FeatureSpec.of("f", "zscore", ["score"]), fin(f"({S} - (SELECT avg({S}) FROM records)) / (SELECT stddev_samp({S}) FROM records)")),
}


def _x_query(spec: FeatureSpec):
    def run(spark, sf):
        df = records(spark, sf)
        state = fit_features(df, [spec])
        out = apply_features(df.select("record_id", *set(spec.inputs)), [spec], state)
        # per-row arithmetic is bit-identical across engines; only values built
        # on order-dependent aggregates (mean, std) are rounded for comparison
        return out.select("record_id", F.round("f", 6).alias("f") if spec.op == "zscore" else F.col("f"))
    return run


for _name, (_spec, _sql) in X_CASES.items():
    _out = f"round({_sql}, 6)" if _spec.op == "zscore" else _sql
    register(_name, records_cte() + f"SELECT record_id, {_out} AS f FROM records")(_x_query(_spec))


# ── X25, X26 ────────────────────────────────────────────────────────────────
PROPOSED = [
    FeatureSpec.of("Score Per Backlog", "per_unit", ["score", "backlogs"]),
    FeatureSpec.of("dept_flag", "binarize_equals", ["department"], value="2-HIGH"),
    FeatureSpec.of("bad_input", "sum", ["score", "no_such_column"]),
    FeatureSpec.of("numeric_on_text", "log1p", ["department"]),
    FeatureSpec.of("score", "scale", ["attendance"], factor=2),
    FeatureSpec.of("weights_wrong", "weighted_sum", ["score", "aptitude"], weights=[1]),
    FeatureSpec.of("att_z", "zscore", ["attendance"]),
    FeatureSpec.of("clip_nothing", "clip", ["rating"]),
    FeatureSpec.of("balance_max", "normalize_max", ["balance"]),
]


@register("x25_feature_plan", records_cte() + (
    f"SELECT record_id, {sdiv(S, f'{BL} + 1.0')} AS score_per_backlog, "
    f"CAST({DEPT_TXT} = '2-HIGH' AS DOUBLE) AS dept_flag, "
    f"round({fin(f'({A} - (SELECT avg({A}) FROM records)) / (SELECT stddev_samp({A}) FROM records)')}, 6) AS att_z, "
    f"{fin(f'{B} / (SELECT max({B}) FROM records)')} AS balance_max FROM records"))
def x25_feature_plan(spark, sf):
    df = records(spark, sf)
    numeric = ["score", "attendance", "aptitude", "balance", "projects", "backlogs", "rating"]
    kept, _dropped = validate_features(PROPOSED, numeric, ["department", "training"], df.columns)
    state = fit_features(df, kept)
    out = apply_features(df, kept, state)
    return out.select("record_id", *[F.round(s.name, 6).alias(s.name) if s.op == "zscore" else F.col(s.name) for s in kept])


X26_SQL = records_cte(
    "c AS (SELECT record_id, " + ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM records), 0.0) AS {c}" for c in C15_COLS)
    + ", training, CASE WHEN balance IS NULL THEN 1.0 ELSE 0.0 END AS mb FROM records)") + (
    "SELECT record_id, round((aptitude + attendance + score) / 3.0, 6) AS percentage_composite, "
    "round(greatest(aptitude, attendance, score) - least(aptitude, attendance, score), 6) AS percentage_spread, "
    "round(least(aptitude, attendance, score), 6) AS percentage_weakest, "
    "round((backlogs + projects) / 2.0, 6) AS count_composite, round(backlogs + projects, 6) AS count_total, "
    "round(backlogs / (SELECT max(backlogs) FROM c), 6) AS backlogs_normalized, "
    "round(projects / (SELECT max(projects) FROM c), 6) AS projects_normalized, "
    "CAST(trim(training) = 'No' AS DOUBLE) AS training_is_no, mb AS balance_was_missing FROM c")


def record_features(spark, sf):
    """Profile → roles → auto cleaning (fit) → auto features (fit) over `records`."""
    df, p, rows, numeric, categorical = record_plan(spark, sf)
    state = fit_cleaning(df, auto_rules(rows, numeric, categorical))
    cleaned = apply_cleaning(df, state, keep=("record_id", "outcome"))
    tops = prof.top_values(df, p, k=1).collect()
    top = {r["column"]: r["value"] for r in tops}
    specs = auto_features(rows, numeric, categorical, top)
    fstate = fit_features(cleaned, specs)
    return apply_features(cleaned, specs, fstate), specs, fstate, state, rows, numeric, categorical


@register("x26_auto_features", X26_SQL)
def x26_auto_features(spark, sf):
    feats, specs, *_ = record_features(spark, sf)
    return feats.select("record_id", *[F.round(s.name, 6).alias(s.name) for s in specs])
