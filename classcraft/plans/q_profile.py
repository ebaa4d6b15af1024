"""Registered queries: sources (S1–S4), profiling (P1–P16), rows/roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classcraft.catalog import records_cte, register
from classcraft.operators import profile as prof
from classcraft.operators import ranks, roles, target
from classcraft.operators.clean import auto_rules, fit_cleaning
from classcraft.operators.schema import input_schema
from classcraft.session import ensure_checkpoint_dir
from classcraft.sources import io
from classcraft.sources.tables import records, table

# Fixed fixture facts: the `records` columns and their Spark types.
RECORD_TYPES = [
    ("record_id", "bigint"), ("score", "double"), ("attendance", "double"), ("aptitude", "double"),
    ("balance", "double"), ("projects", "int"), ("backlogs", "int"), ("rating", "double"),
    ("stipend", "string"), ("department", "string"), ("training", "string"), ("campus", "string"),
    ("notes", "string"), ("outcome", "string"),
]
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")
WS = r"'^\s+|\s+$', '', 'g'"
NUM_RE = r"'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local on a cluster)."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _profile(spark, sf, median=False):
    return prof.profile(records(spark, sf), median)


# ── SQL pieces for the profile oracle ───────────────────────────────────────
def _sql_parse(c: str) -> str:
    t = f"regexp_replace(CAST({c} AS VARCHAR), {WS})"
    return f"CASE WHEN regexp_matches({t}, {NUM_RE}) THEN TRY_CAST({t} AS DOUBLE) END"


def _sql_stats_row(pos: int, c: str, t: str) -> str:
    numeric = t in NUMERIC_TYPES
    v = f"CAST({c} AS DOUBLE)" if numeric else (_sql_parse(c) if t == "string" else "CAST(NULL AS DOUBLE)")
    integral = "TRUE" if t in ("tinyint", "smallint", "int", "bigint") else f"coalesce(bool_and(CASE WHEN {v} IS NOT NULL THEN {v} % 1 = 0 END), FALSE)"
    if t == "string":
        stripped = f"replace(regexp_replace({c}, {WS}), ',', '')"
        like = (f"coalesce(avg(CASE WHEN {c} IS NOT NULL THEN CASE WHEN regexp_matches({stripped}, {NUM_RE}) "
                f"AND TRY_CAST({stripped} AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END END) > 0.9, FALSE)")
    else:
        like = "FALSE"
    return (f"SELECT '{c}' AS column, {pos} AS position, '{t}' AS dtype, count(*) AS n_rows, "
            f"count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique, "
            f"min({v}) AS minimum, max({v}) AS maximum, avg({v}) AS mean, "
            f"coalesce(stddev_samp({v}), CASE WHEN count({v}) > 0 THEN 0.0 END) AS std, "
            f"quantile_cont({v}, 0.5) AS median, {integral} AS integral_raw, count({v}) AS n_numeric, "
            f"{like} AS numeric_like_raw, {'TRUE' if numeric else 'FALSE'} AS numeric_dtype FROM records")


def profile_sql_cte(types=RECORD_TYPES, source_cte: str | None = None) -> str:
    """A `prof` CTE reproducing P1–P5, P8, P9 in SQL, one UNION ALL branch per column."""
    stats = " UNION ALL ".join(_sql_stats_row(i, c, t) for i, (c, t) in enumerate(types))
    kind = ("CASE WHEN n_missing = n_rows THEN 'empty' WHEN n_unique <= 1 THEN 'constant' "
            "WHEN dtype = 'boolean' THEN 'boolean' "
            "WHEN numeric_dtype THEN CASE WHEN n_unique = 2 THEN 'boolean' ELSE 'numeric' END "
            "WHEN n_unique <= 50 OR (n_rows > 0 AND n_unique / n_rows < 0.5) THEN 'categorical' ELSE 'text' END")
    measured = "(kind IN ('numeric', 'boolean') AND n_numeric > 0)"
    ident = ("((is_integral OR kind NOT IN ('numeric', 'boolean')) AND unique_ratio >= 0.95 AND n_rows > 20) "
             "OR \"column\" LIKE '%\\_id' ESCAPE '\\' OR \"column\" LIKE '%\\_no' ESCAPE '\\' OR \"column\" LIKE '%\\_number' ESCAPE '\\' "
             "OR \"column\" IN ('id', 'index', 'sl_no', 'serial', 'roll', 'roll_no', 'uid')")
    return (
        f"stats AS ({stats}),\n"
        f"k AS (SELECT *, {kind} AS kind, CASE WHEN n_rows > 0 THEN n_unique / n_rows ELSE 0.0 END AS unique_ratio FROM stats),\n"
        f"m AS (SELECT \"column\", position, dtype, n_rows, n_missing, "
        f"CASE WHEN n_rows > 0 THEN n_missing / n_rows * 100.0 ELSE 0.0 END AS missing_pct, n_unique, unique_ratio, kind, "
        f"CASE WHEN {measured} THEN minimum END AS minimum, CASE WHEN {measured} THEN maximum END AS maximum, "
        f"CASE WHEN {measured} THEN mean END AS mean, CASE WHEN {measured} THEN std END AS std, "
        f"CASE WHEN {measured} THEN median END AS median, CASE WHEN {measured} THEN integral_raw ELSE FALSE END AS is_integral, "
        f"numeric_like_raw AND NOT numeric_dtype AS numeric_like FROM k),\n"
        f"prof AS (SELECT *, {ident} AS is_identifier FROM m)\n"
    )


PROFILE = records_cte(profile_sql_cte())


# ── S1–S4 ───────────────────────────────────────────────────────────────────
RECORD_COLS_SQL = ", ".join(c for c, _ in RECORD_TYPES)


@register("s1_read_csv", records_cte() + f"SELECT CAST(record_id AS INTEGER) AS record_id, {', '.join(c for c, _ in RECORD_TYPES[1:])} FROM records")
def s1_read_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The records table written as CSV, read back with inferred types."""
    path = scratch(spark, "s1")
    io.write_table(records(spark, sf), path, "csv")
    return io.read_table(spark, path, "csv")


# Lines of a delimited file: every 40th a cell short, every 40th a cell long, every 40th with words where a number belongs.
BROKEN = {1: "concat(o_orderkey, ',', o_orderstatus)", 2: "concat(o_orderkey, ',', o_orderstatus, ',', o_custkey, ',extra')",
          3: "concat(o_orderkey, ',', o_orderstatus, ',about ', o_custkey)"}
LINE = "CASE o_orderkey % 40 " + " ".join(f"WHEN {k} THEN {v}" for k, v in BROKEN.items()) + " ELSE concat(o_orderkey, ',', o_orderstatus, ',', o_custkey) END"


@register("s1_quarantine", "WITH l AS (SELECT *, " + LINE + " AS line, o_orderkey % 40 IN (1, 2, 3) AS bad, count(*) OVER () AS lines, "
          "count(*) FILTER (o_orderkey % 40 IN (1, 2, 3)) OVER () AS quarantined FROM orders) "
          "SELECT CASE WHEN NOT bad THEN o_orderkey END AS id, CASE WHEN NOT bad THEN o_orderstatus END AS status, CASE WHEN NOT bad THEN o_custkey END AS customer, "
          "CASE WHEN bad THEN line END AS line, lines, quarantined FROM l")
def s1_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Good rows and malformed lines of one scan, and their counts."""
    path = scratch(spark, "lines")
    table(spark, sf, "orders").select(F.expr(LINE).alias("line")).write.text(path)
    good, bad, counts = io.read_checked(spark, path, "id long, status string, customer long", scratch(spark, "checked"), header="false")
    both = good.select("*", F.lit(None).cast("string").alias("line")).unionByName(
        bad.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("customer"), "line"))
    return both.select("*", F.lit(counts["lines"]).cast("long").alias("lines"), F.lit(counts["quarantined"]).cast("long").alias("quarantined"))


@register("s2_write_scored_csv", records_cte() + "SELECT record_id, outcome, round(1 / (1 + exp(-(0.06 * (score - 50) + 0.5 * projects - 1.25))), 6) AS probability FROM records")
def s2_write_scored_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A scored table written as CSV (header) and read back."""
    from classcraft.sources.tables import FORMULA_SCORE_SQL

    path = scratch(spark, "s2")
    scored = records(spark, sf).select("record_id", "outcome", F.expr(FORMULA_SCORE_SQL).alias("probability"))
    io.write_table(scored, path, "csv")
    back = io.read_table(spark, path, "csv")
    return back.select(F.col("record_id").cast("bigint"), "outcome", "probability")


MESSY_HEADERS = {
    "record_id": "Record ID", "score": "Score %", "attendance": "Attendance  (%)", "aptitude": "  Aptitude",
    "balance": "Balance $", "projects": "# Projects", "backlogs": "Backlogs", "rating": "Rating★",
    "stipend": "Stipénd", "department": " Department ", "training": "Training?", "campus": "Campus",
    "notes": "Notes...", "outcome": "OUTCOME",
}


@register("s3_canonical_headers", records_cte() + f"SELECT {RECORD_COLS_SQL} FROM records")
def s3_canonical_headers(spark: SparkSession, sf: str) -> DataFrame:
    """S3: messy headers canonicalised back to snake_case."""
    df = records(spark, sf)
    messy = df.toDF(*[MESSY_HEADERS[c] for c in df.columns])
    out, _ = io.canonicalize_columns(messy)
    return out


@register("s4_seeded_sample", records_cte() + f"SELECT {RECORD_COLS_SQL} FROM records ORDER BY md5(CAST(record_id AS VARCHAR) || '|42'), record_id LIMIT 1000")
def s4_seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Repeatable seeded sample of at most 1,000 rows (a sampling operator)."""
    return io.seeded_sample(records(spark, sf), "record_id", 1000)


# ── P1–P10 ──────────────────────────────────────────────────────────────────
@register("p1_missing", PROFILE + "SELECT \"column\", n_rows, n_missing, round(missing_pct, 6) AS missing_pct FROM prof")
def p1_missing(spark, sf):
    return prof.missing_counts(records(spark, sf)).select("column", "n_rows", "n_missing", r6("missing_pct").alias("missing_pct"))


@register("p2_distinct", PROFILE + "SELECT \"column\", n_unique, round(unique_ratio, 6) AS unique_ratio FROM prof")
def p2_distinct(spark, sf):
    return _profile(spark, sf).select("column", "n_unique", r6("unique_ratio").alias("unique_ratio"))


@register("p3_kind", PROFILE + "SELECT \"column\", kind FROM prof")
def p3_kind(spark, sf):
    return _profile(spark, sf).select("column", "kind")


@register("p4_moments", PROFILE + "SELECT \"column\", round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median FROM prof WHERE kind IN ('numeric', 'boolean')")
def p4_moments(spark, sf):
    p = _profile(spark, sf, median=True).where(F.col("kind").isin("numeric", "boolean"))
    return p.select("column", *[r6(c).alias(c) for c in ("minimum", "maximum", "mean", "std", "median")])


@register("p5_integral", PROFILE + "SELECT \"column\", is_integral FROM prof")
def p5_integral(spark, sf):
    return _profile(spark, sf).select("column", "is_integral")


def _vc_sql(types=RECORD_TYPES) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM records WHERE {c} IS NOT NULL GROUP BY 2"
        for c, _ in types)


@register("p6_top_values", PROFILE.rstrip() + f",\nvc AS ({_vc_sql()})\n"
          "SELECT \"column\", rank, value, n FROM (SELECT vc.\"column\", value, n, row_number() OVER (PARTITION BY vc.\"column\" ORDER BY n DESC, value) AS rank "
          "FROM vc JOIN prof USING (\"column\") WHERE kind IN ('categorical', 'boolean', 'constant')) WHERE rank <= 10")
def p6_top_values(spark, sf):
    df = records(spark, sf)
    return prof.top_values(df).select("column", F.col("rank").cast("bigint").alias("rank"), "value", "n")


@register("p7_sample_values", records_cte(f"vc AS ({_vc_sql()})")
          + "SELECT \"column\", rank, value FROM (SELECT \"column\", value, row_number() OVER (PARTITION BY \"column\" ORDER BY value) AS rank FROM vc) WHERE rank <= 6")
def p7_sample_values(spark, sf):
    return prof.sample_values(records(spark, sf)).select("column", F.col("rank").cast("bigint").alias("rank"), "value")


@register("p8_numeric_like", PROFILE + "SELECT \"column\", numeric_like FROM prof")
def p8_numeric_like(spark, sf):
    return prof.numeric_like(records(spark, sf))


@register("p9_identifier", PROFILE + "SELECT \"column\", is_identifier FROM prof")
def p9_identifier(spark, sf):
    return _profile(spark, sf).select("column", "is_identifier")


RECORDS_DUP = "records_dup AS (SELECT * FROM records UNION ALL SELECT * FROM records WHERE training = 'Yes')"


def records_dup(spark, sf):
    r = records(spark, sf)
    return r.unionByName(r.where(F.col("training") == "Yes"))


@register("p10_duplicates", records_cte(RECORDS_DUP) + f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM records_dup GROUP BY {RECORD_COLS_SQL})")
def p10_duplicates(spark, sf):
    return prof.duplicate_rows(records_dup(spark, sf))


# ── P11–P16 ─────────────────────────────────────────────────────────────────
def _hint_sql() -> str:
    parts = []
    for rank, h in enumerate(target.TARGET_NAME_HINTS):
        parts.append(f"WHEN lower(\"column\") = '{h}' THEN {100.0 - rank} WHEN contains(lower(\"column\"), '{h}') THEN {60.0 - rank}")
    return "CASE " + " ".join(parts) + " ELSE 0.0 END"


@register("p11_target_candidates", PROFILE + (
    "SELECT \"column\", round(score, 6) AS score, rank FROM (SELECT \"column\", score, row_number() OVER (ORDER BY score DESC, \"column\") AS rank FROM ("
    f"SELECT \"column\", kind, is_identifier, {_hint_sql()} + CASE WHEN n_unique = 2 THEN 30.0 WHEN n_unique > 2 AND n_unique <= 10 THEN 10.0 ELSE 0.0 END "
    "+ position / greatest((SELECT max(position) FROM prof), 1) * 5.0 AS score FROM prof) "
    "WHERE kind NOT IN ('constant', 'empty', 'text', 'datetime') AND NOT is_identifier AND score > 0) WHERE rank <= 5"))
def p11_target_candidates(spark, sf):
    c = target.target_candidates(_profile(spark, sf))
    return c.select("column", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _describe_sql(tbl: str, col: str, is_float: bool) -> str:
    task = ("CASE WHEN k = 2 THEN 'binary_classification' "
            + ("" if is_float else "WHEN k > 2 AND k <= 20 THEN 'multiclass_classification' ")
            + "ELSE 'regression' END")
    return (f"c AS (SELECT CAST({col} AS VARCHAR) AS value, count(*) AS n FROM {tbl} WHERE {col} IS NOT NULL GROUP BY 1), "
            f"kk AS (SELECT count(*) AS k FROM c) "
            f"SELECT value, n, rank, k AS n_classes, {task} AS task_type FROM "
            f"(SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM c), kk WHERE rank <= 20")


@register("p12_describe_target", records_cte() + ", " + _describe_sql("records", "outcome", False))
def p12_describe_target(spark, sf):
    return target.describe_target(records(spark, sf), "outcome").select("value", "n", F.col("rank").cast("bigint").alias("rank"), "n_classes", "task_type")


@register("p12_describe_multiclass", "WITH " + _describe_sql("lineitem", "l_returnflag", False))
def p12_describe_multiclass(spark, sf):
    return target.describe_target(table(spark, sf, "lineitem"), "l_returnflag").select("value", "n", F.col("rank").cast("bigint").alias("rank"), "n_classes", "task_type")


def _positive_sql(tbl: str, col: str, where: str = "") -> str:
    tok = "replace(replace(lower(trim(value)), ' ', ''), '-', '_')"
    pos = ", ".join(f"'{t}'" for t in target.POSITIVE_TOKENS)
    neg = ", ".join(f"'{t}'" for t in target.NEGATIVE_TOKENS)
    num = f"CASE WHEN regexp_matches(trim(value), {NUM_RE}) THEN TRY_CAST(trim(value) AS DOUBLE) END"
    return (f"c AS (SELECT CAST({col} AS VARCHAR) AS value, count(*) AS n FROM {tbl} WHERE {col} IS NOT NULL {where} GROUP BY 1), "
            f"r AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS r, CASE WHEN {tok} IN ({pos}) THEN 1 ELSE 0 END AS is_pos, "
            f"CASE WHEN {tok} IN ({neg}) THEN 1 ELSE 0 END AS is_neg, {num} AS num FROM c), "
            "a AS (SELECT sum(is_pos) AS n_pos, sum(is_neg) AS n_neg, count(*) AS n_levels, count(num) AS n_numeric, "
            "arg_max(value, n * 1e9 - r) FILTER (WHERE is_pos = 1) AS pos, arg_max(value, n * 1e9 - r) FILTER (WHERE is_neg = 0) AS not_neg, "
            "arg_max(value, num * 1e9 - r) AS num_max, arg_max(value, n * 1e9 - r) AS mode FROM r) "
            "SELECT CASE WHEN n_pos = 1 THEN pos WHEN n_neg = 1 AND n_levels = 2 THEN not_neg "
            "WHEN n_numeric = n_levels THEN num_max ELSE mode END AS positive_class FROM a")


@register("p13_positive_class", records_cte() + ", " + _positive_sql("records", "outcome"))
def p13_positive_class(spark, sf):
    return target.positive_class(target.class_counts(records(spark, sf), "outcome"))


@register("p13_positive_numeric", "WITH " + _positive_sql("labels", "quality"))
def p13_positive_numeric(spark, sf):
    return target.positive_class(target.class_counts(table(spark, sf, "labels"), "quality"))


@register("p14_class_balance", "WITH c AS (SELECT CAST(quality AS VARCHAR) AS value, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1) "
          "SELECT value, n, round_even(n / (SELECT sum(n) FROM c) * 100.0, 2) AS share, "
          "round(CASE WHEN (SELECT count(*) FROM c) > 1 THEN ((SELECT max(n) FROM c) - (SELECT min(n) FROM c)) / (SELECT sum(n) FROM c) * 100.0 ELSE 0.0 END, 6) AS imbalance FROM c")
def p14_class_balance(spark, sf):
    b = target.class_balance(table(spark, sf, "labels"), "quality")
    return b.select("value", "n", "share", r6("imbalance").alias("imbalance"))


@register("p15_target_guard", "SELECT 'continuous' AS rule, CAST(NULL AS VARCHAR) AS value, count(DISTINCT p_name) AS n FROM part")
def p15_target_guard(spark, sf):
    return target.target_guard(table(spark, sf, "part"), "p_name")


@register("p15_target_guard_ok", records_cte() + "SELECT 'thin_class' AS rule, outcome AS value, count(*) AS n FROM records GROUP BY outcome HAVING count(*) < 5")
def p15_target_guard_ok(spark, sf):
    return target.target_guard(records(spark, sf), "outcome")


def record_plan(spark, sf, df=None):
    """Profile → roles → cleaning rules for `records` (driver sees one row per column); ``df``: the same rows, kept by the caller."""
    df = records(spark, sf) if df is None else df
    p = prof.profile(df, median=False)
    rows = prof.profile_rows(p)
    rl = {r["column"]: r["role"] for r in roles.auto_roles(p, "outcome").collect()}
    numeric = [r["column"] for r in rows if rl.get(r["column"]) == "numeric_feature"]
    categorical = [r["column"] for r in rows if rl.get(r["column"]) == "categorical_feature"]
    return df, p, rows, numeric, categorical


P16_SQL = records_cte() + (
    ", num AS (SELECT name, 'numeric' AS kind, lo AS min, hi AS max, med AS \"default\", "
    "CASE WHEN integer THEN 1.0 ELSE round(greatest((hi - lo) / 100, 0.01), 4) END AS step, integer FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med, "
        + ("TRUE" if t in ("int", "bigint") else f"coalesce(bool_and(CAST({c} AS DOUBLE) % 1 = 0), TRUE)") + " AS integer FROM records"
        for c, t in RECORD_TYPES if c in ("score", "attendance", "aptitude", "balance", "projects", "backlogs", "rating"))
    + ")) "
    "SELECT name, kind, round(min, 6) AS min, round(max, 6) AS max, round(\"default\", 6) AS \"default\", step, integer, "
    "CAST(NULL AS VARCHAR) AS levels, CAST(NULL AS VARCHAR) AS default_level FROM num UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{c}', 'categorical', NULL, NULL, NULL, NULL, NULL, "
        f"(SELECT string_agg(level, '|' ORDER BY level) FROM (SELECT regexp_replace({c}, {WS}) AS level, count(*) AS n FROM records WHERE {c} IS NOT NULL GROUP BY 1) "
        f"WHERE n / (SELECT count({c}) FROM records) >= 0.01), "
        f"(SELECT value FROM (SELECT {c} AS value, count(*) AS n FROM records WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, value LIMIT 1)"
        for c in ("department", "training")))


@register("p16_input_schema", P16_SQL)
def p16_input_schema(spark, sf):
    df, p, rows, numeric, categorical = record_plan(spark, sf)
    rules = auto_rules(rows, numeric, categorical)
    state = fit_cleaning(df, rules)
    s = input_schema(df, numeric, categorical, state.kept)
    return s.select("name", "kind", r6("min").alias("min"), r6("max").alias("max"), r6("default").alias("default"),
                    "step", "integer", F.array_join("levels", "|").alias("levels"), "default_level")


# ── F1–F5 ───────────────────────────────────────────────────────────────────
@register("f1_drop_missing_target", records_cte() + f"SELECT {RECORD_COLS_SQL} FROM records WHERE balance IS NOT NULL")
def f1_drop_missing_target(spark, sf):
    return roles.drop_missing_target(records(spark, sf), "balance")


@register("f2_drop_duplicates", records_cte(RECORDS_DUP) + f"SELECT DISTINCT {RECORD_COLS_SQL} FROM records_dup")
def f2_drop_duplicates(spark, sf):
    return roles.drop_duplicate_rows(records_dup(spark, sf))


ROLE_SQL = PROFILE + (
    "SELECT \"column\", CASE WHEN \"column\" = 'outcome' THEN 'target' WHEN is_identifier THEN 'identifier' "
    "WHEN kind IN ('constant', 'empty', 'text', 'datetime') THEN 'drop' WHEN missing_pct > 60 THEN 'drop' "
    "WHEN kind = 'numeric' THEN 'numeric_feature' "
    "WHEN kind = 'boolean' THEN CASE WHEN dtype IN ('tinyint', 'smallint', 'int', 'bigint', 'float', 'double', 'boolean') THEN 'numeric_feature' ELSE 'categorical_feature' END "
    "WHEN n_unique > 50 THEN 'drop' ELSE 'categorical_feature' END AS role FROM prof")


@register("f3_column_roles", ROLE_SQL)
def f3_column_roles(spark, sf):
    return roles.auto_roles(_profile(spark, sf), "outcome").select("column", "role")


PARTIAL_COLS = [c for c, _ in RECORD_TYPES if c != "attendance"]


@register("f4_reconcile", records_cte() + "SELECT " + ", ".join("CAST(NULL AS DOUBLE) AS attendance" if c == "attendance" else c for c, _ in RECORD_TYPES) + " FROM records")
def f4_reconcile(spark, sf):
    partial = records(spark, sf).select(*PARTIAL_COLS, F.lit(1).alias("unexpected_extra"))
    out, _report = roles.reconcile(partial, RECORD_TYPES)
    return out


@register("f5_fill_defaults", records_cte() + "SELECT record_id, score, (SELECT quantile_cont(attendance, 0.5) FROM records) AS attendance FROM records")
def f5_fill_defaults(spark, sf):
    df = records(spark, sf)
    median = ranks.medians(df, {"attendance": F.col("attendance")})["attendance"]
    partial = df.select("record_id", "score")
    return roles.fill_defaults(partial, {"record_id": None, "score": 0.0, "attendance": float(median)})
