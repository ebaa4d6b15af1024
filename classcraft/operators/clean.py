"""Learned cleaning (C1–C15): fit once on the training rows, apply verbatim.

``fit_cleaning`` learns every fill value in one aggregate pass and every kept
level set in one long-form ``groupBy`` (both map-side combined); only the
small constants reach the driver. ``apply_cleaning`` is a single projection,
so scoring a batch or a single row runs the same expressions.

Order per column: coerce → trim → lower → missing flag → fill → (numeric:
parse, clip, NULL→0.0 | text: NULL→'Other', fold rare levels).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classcraft.functions.expr import OTHER, coerce_numeric, is_numeric_type, parse_number, strip_ws
from classcraft.functions.features import missing_flag
from classcraft.operators import ranks

IMPUTE = ("median", "mean", "most_frequent", "constant", "none")
DEFAULT_RARE_SHARE = 0.01
LEAST_RARE_SHARE = 1e-4  # a smaller share is raised to it, so a column keeps at most 10,000 levels


@dataclass
class CleanRule:
    column: str
    coerce_numeric: bool = False
    strip_whitespace: bool = False
    lowercase: bool = False
    impute: str = "median"
    fill_value: Any = None
    clip_min: float | None = None
    clip_max: float | None = None
    rare_min_frequency: float | None = None

    def __post_init__(self):
        if self.impute not in IMPUTE:
            self.impute = "median"
        if self.rare_min_frequency is not None:
            f = min(float(self.rare_min_frequency), 0.2)
            self.rare_min_frequency = max(f, LEAST_RARE_SHARE) if f > 0 else 0.0


@dataclass
class CleaningState:
    columns: list[str]
    numeric: list[str]
    fill: dict[str, Any] = field(default_factory=dict)
    kept: dict[str, list[str]] = field(default_factory=dict)
    rules: dict[str, dict] = field(default_factory=dict)

    def rule(self, column: str) -> CleanRule | None:
        r = self.rules.get(column)
        return CleanRule(**r) if r else None

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> "CleaningState":
        return CleaningState(**d)

    def output_columns(self) -> list[str]:
        return self.columns + [missing_flag(c) for c in self.columns]


def auto_rules(prof_rows: list[dict], numeric_features: list[str], categorical_features: list[str],
               user_rules: list[CleanRule] | None = None) -> list[CleanRule]:
    """Default rules by shape; user rules win, gaps get the defaults."""
    by_name = {r["column"]: r for r in prof_rows}
    user = {r.column: r for r in (user_rules or [])}
    rules = []
    for name in [*numeric_features, *categorical_features]:
        if name in user:
            rules.append(user[name])
        elif name in numeric_features:
            rules.append(CleanRule(name, coerce_numeric=bool(by_name.get(name, {}).get("numeric_like")), impute="median"))
        else:
            rules.append(CleanRule(name, strip_whitespace=True, impute="most_frequent", rare_min_frequency=DEFAULT_RARE_SHARE))
    return rules


def _prepared(df_types: dict[str, str], rule: CleanRule | None, column: str) -> tuple[Column, bool]:
    """The column after coerce/trim/lower, and whether it is numeric."""
    dtype = df_types.get(column)
    x = F.col(f"`{column}`") if dtype is not None else F.lit(None).cast("string")
    numeric = dtype is not None and (is_numeric_type(dtype) or dtype == "boolean")
    if rule is not None and rule.coerce_numeric and not numeric:
        x = coerce_numeric(x)
        numeric = True
    elif numeric:
        x = x.cast("double")
    if rule is not None and not numeric:
        if rule.strip_whitespace:
            x = strip_ws(x.cast("string"))
        if rule.lowercase:
            x = F.lower(x.cast("string"))
    return x, numeric


def fit_cleaning(train: DataFrame, rules: list[CleanRule], columns: list[str] | None = None) -> CleaningState:
    """Learn fill values (C5–C9) and kept levels (C11) from the training rows.

    Medians and modes are exact at every size (`ranks`); means are one aggregate.
    """
    types = dict(train.dtypes)
    by_col = {r.column: r for r in rules}
    columns = [c for c in (columns or [r.column for r in rules]) if c in types]
    numeric_cols: list[str] = []
    means, medians, modes = {}, {}, {}
    for c in columns:
        rule = by_col.get(c)
        series = F.col(f"`{c}`")
        numeric = is_numeric_type(types[c]) or types[c] == "boolean"
        if rule is not None and rule.coerce_numeric and not numeric:
            series, numeric = coerce_numeric(series), True
        if numeric:
            numeric_cols.append(c)
        strategy = rule.impute if rule else "median"
        value = series.cast("double") if numeric else parse_number(series)
        if strategy == "mean":
            means[c] = value
        elif strategy == "median":
            medians[c] = value
        elif strategy == "most_frequent":
            modes[c] = (value if numeric else series, numeric)
    learned: dict[str, Any] = {**ranks.medians(train, medians), **ranks.modes(train, modes)}
    if means:
        row = train.agg(*[F.avg(v).alias(f"f{i}") for i, v in enumerate(means.values())]).first()
        learned |= {c: row[f"f{i}"] for i, c in enumerate(means)}

    fill: dict[str, Any] = {}
    for c in columns:
        rule = by_col.get(c)
        strategy = rule.impute if rule else "median"
        if strategy == "none":
            continue
        if strategy == "constant":
            fill[c] = rule.fill_value if rule is not None and rule.fill_value is not None else 0
        elif strategy in ("median", "mean"):
            v = learned.get(c)
            fill[c] = 0.0 if v is None else float(v)
        else:
            v = learned.get(c)
            fill[c] = OTHER if v is None else (float(v) if c in numeric_cols else v)

    kept = fit_kept_levels(train, [r for r in rules if r.column in columns and r.rare_min_frequency])
    return CleaningState(columns=columns, numeric=numeric_cols, fill=fill, kept=kept,
                         rules={r.column: asdict(r) for r in rules if r.column in columns})


def fit_kept_levels(train: DataFrame, rules: list[CleanRule]) -> dict[str, list[str]]:
    """C11: per column, trimmed levels whose share of non-null values is ≥ f.

    All columns in one long-form pass: explode (column, level) → count →
    share against the column's non-null total (small per-column join).
    """
    if not rules:
        return {}
    cells = F.array(*[
        F.struct(F.lit(r.column).alias("column"), strip_ws(F.col(f"`{r.column}`").cast("string")).alias("level"))
        for r in rules
    ])
    counts = (
        train.select(F.explode(cells).alias("c")).select("c.*")
        .where(F.col("level").isNotNull())
        .groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    thresholds = train.sparkSession.createDataFrame([(r.column, float(r.rare_min_frequency)) for r in rules], "column string, f double")
    kept_rows = (
        counts.join(F.broadcast(totals), "column").join(F.broadcast(thresholds), "column")
        .where(F.col("n") / F.col("total") >= F.col("f"))
        .select("column", "level", "n")
        .collect()  # bounded: at most 1/f levels per column
    )
    kept: dict[str, list[tuple[int, str]]] = {r.column: [] for r in rules}
    for r in kept_rows:
        kept[r["column"]].append((-r["n"], r["level"]))
    return {c: [lvl for _, lvl in sorted(v)] for c, v in kept.items()}


def cleaning_exprs(state: CleaningState, df_types: dict[str, str]) -> list[Column]:
    """The projection that cleans: cleaned columns, then the missing flags (C4)."""
    values, flags = [], []
    for c in state.columns:
        rule = state.rule(c)
        x, _ = _prepared(df_types, rule, c)
        numeric = c in state.numeric
        if numeric:
            x = x.cast("double")
        flags.append(x.isNull().cast("double").alias(missing_flag(c)))
        fill = state.fill.get(c)
        if numeric:
            if fill is not None:
                fv = fill if isinstance(fill, (int, float)) else parse_number(F.lit(str(fill)))
                x = F.coalesce(x, F.lit(fv) if not isinstance(fv, Column) else fv)
            if rule is not None and (rule.clip_min is not None or rule.clip_max is not None):
                clipped = x
                if rule.clip_min is not None:
                    clipped = F.greatest(clipped, F.lit(float(rule.clip_min)))
                if rule.clip_max is not None:
                    clipped = F.least(clipped, F.lit(float(rule.clip_max)))
                x = F.when(x.isNotNull(), clipped)
            x = F.coalesce(x, F.lit(0.0))
        else:
            x = x.cast("string")
            if fill is not None:
                x = F.coalesce(x, F.lit(str(fill)))
            x = F.coalesce(x, F.lit(OTHER))
            keep = state.kept.get(c)
            if keep:
                x = F.when(x.isin(*keep), x).otherwise(F.lit(OTHER))
        values.append(x.alias(c))
    return values + flags


def apply_cleaning(df: DataFrame, state: CleaningState, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Transform any table with the fitted state; ``keep`` passes columns through (key, target)."""
    types = dict(df.dtypes)
    passthrough = [F.col(f"`{c}`") for c in keep if c in types and c not in state.columns]
    return df.select(*passthrough, *cleaning_exprs(state, types))
