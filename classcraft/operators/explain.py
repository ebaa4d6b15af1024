"""Batch counterfactual explanations (A1–A5).

The reference explains one record at a time; here every operator works on a
whole table as set operations: ``explode`` the fields (or the grid points)
next to each record, rewrite one column per exploded row with a CASE on the
field index, score the whole exploded frame once, and rank per record with a
window partitioned by the record key (the partition is one record's rows:
fields × grid points, bounded by the schema, never by the data).

Fields come from the input schema (P16): ``name``, ``kind``, ``min``,
``max``, ``default``, ``integer``, ``levels``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classcraft.functions.expr import np_round
from classcraft.operators.score import INPUT, Scorer
from classcraft.session import dealt

CURVE_POINTS = 25
MAX_LEVERS = 4
NON_NUMERIC_DISTANCE = 1e9
CHANGES = "array<struct<field: int, step: int>>"


def _typed_lit(value, dtype: str) -> Column:
    return F.lit(value).cast(dtype)


def _swap(df_types: dict[str, str], fields: list[dict], index_col: str, value_col: str | None = None) -> list[Column]:
    """Columns with field ``i`` replaced when ``index_col == i`` (by its default, or ``value_col``)."""
    out = []
    for i, f in enumerate(fields):
        name, dtype = f["name"], df_types.get(f["name"], "string")
        new = _typed_lit(f.get("default"), dtype) if value_col is None else F.col(value_col).cast(dtype)
        out.append(F.when(F.col(index_col) == i, new).otherwise(F.col(f"`{name}`")).alias(name))
    return out


def _scored(scorer: Scorer, df: DataFrame) -> DataFrame:
    """``df`` as it is, with its score."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(INPUT), "*")
    return scorer.transform(whole).select(f"{INPUT}.*", scorer.score_of("probs").alias("_score"))


def attribute(df: DataFrame, key: str, scorer: Scorer, fields: list[dict], top_n: int | None = None) -> DataFrame:
    """A1: per record and field, score minus the score with the typical value.

    Fields equal to their typical value (or without one) are skipped; delta
    is rounded to 4 dp; ranked by |delta| (ties: schema order); top-n.
    Columns: key, rank, column, delta.
    """
    fields = [f for f in fields if f["name"] in df.columns and f.get("default") is not None]
    types = dict(df.dtypes)
    names = [f["name"] for f in fields]
    base = _scored(scorer, dealt(df.select(key, *names), work=len(names))).withColumnRenamed("_score", "_actual")
    differs = F.array(*[
        F.struct(F.lit(i).alias("i"), (F.col(f"`{f['name']}`").isNull() | (F.col(f"`{f['name']}`") != _typed_lit(f["default"], types[f["name"]]))).alias("d"))
        for i, f in enumerate(fields)
    ])
    exploded = base.select("*", F.explode(F.filter(differs, lambda s: s["d"])).alias("_f")).select(
        key, "_actual", F.col("_f.i").alias("_fi"), *[F.col(f"`{n}`") for n in names])
    cf = exploded.select(key, "_actual", "_fi", *_swap(types, fields, "_fi"))
    scored = _scored(scorer, cf)
    delta = np_round(F.col("_actual") - F.col("_score"), 4)
    name_arr = F.array(*[F.lit(n) for n in names])
    w = Window.partitionBy(key).orderBy(F.abs(F.col("delta")).desc(), F.col("_fi"))
    out = scored.select(key, "_fi", F.element_at(name_arr, F.col("_fi") + 1).alias("column"), delta.alias("delta")) \
        .withColumn("rank", F.row_number().over(w))
    if top_n:
        out = out.where(F.col("rank") <= top_n)
    return out.select(key, "rank", "column", "delta")


def _grid(f: dict, start: Column | None = None, points: int = CURVE_POINTS) -> Column:
    """linspace(low, high, points) as an array column (last point exactly ``high``)."""
    lo = F.lit(float(f.get("min", 0.0))) if start is None else start
    hi = F.lit(float(f.get("max", 1.0)))
    step = (hi - lo) / F.lit(float(points - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)),
                       lambda i: F.when(i == points - 1, hi).otherwise(lo + i.cast("double") * step))


def what_if(df: DataFrame, key: str, scorer: Scorer, fields: list[dict], column: str) -> DataFrame:
    """A2: sweep one field across its training range (25 points; integers
    rounded half-even and de-duplicated) or all its levels, others fixed.
    Unknown field or empty range → no rows. Columns: key, point, value, probability.
    """
    spec = next((f for f in fields if f["name"] == column), None)
    spark = df.sparkSession
    empty = spark.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, point int, value string, probability double")
    if spec is None:
        return empty
    types = dict(df.dtypes)
    names = [f["name"] for f in fields if f["name"] in df.columns]
    if spec.get("kind") == "categorical":
        values = F.array(*[F.lit(str(v)) for v in (spec.get("levels") or [])])
    else:
        if float(spec.get("max", 1.0)) <= float(spec.get("min", 0.0)):
            return empty
        g = _grid(spec)
        values = F.array_distinct(F.transform(g, lambda v: F.rint(v) if spec.get("integer") else np_round(v, 4)))
    ex = df.select(key, *names).select("*", F.posexplode(values).alias("point", "_v"))
    cols = [F.col("_v").cast(types[n]).alias(n) if n == column else F.col(f"`{n}`") for n in names]
    scored = _scored(scorer, ex.select(key, "point", "_v", *cols))
    return scored.select(key, "point", F.col("_v").alias("value"), F.col("_score").alias("probability"))


def _once(df: DataFrame) -> DataFrame:
    """``df`` with its columns worked out here: a generator between two projections keeps the optimizer from writing a column's
    expression into each place that reads it, such as a filter that would work out the whole score again."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def _is_numeric(f: dict) -> bool:
    return f.get("kind") != "categorical"


def _now(f: dict) -> Column:
    """The value that a numeric field's steps start from."""
    return F.coalesce(F.col(f"`{f['name']}`").cast("double"), F.lit(float(f.get("min", 0.0))))


def _steps(fields: list[dict]) -> Column:
    """All changes to try on a record, as an array of (field, step): 1 to 24 towards the maximum, or the place of another level."""
    parts = []
    for i, f in enumerate(fields):
        steps = range(1, CURVE_POINTS) if _is_numeric(f) else range(len(f.get("levels") or []))
        all_ = F.array(*[F.struct(F.lit(i).alias("field"), F.lit(s).alias("step")) for s in steps]) if steps else F.array().cast(CHANGES)
        x = F.col(f"`{f['name']}`")
        if _is_numeric(f):
            if f.get("integer"):  # of the steps that round to one number only the first can be the answer
                all_ = F.filter(all_, _new_number(f))
            parts.append(F.when(_now(f) < F.lit(float(f.get("max", 1.0))), all_).otherwise(F.array().cast(CHANGES)))
        else:
            parts.append(F.filter(all_, _other_level(f, x)))
    return F.concat(*parts) if parts else F.array().cast(CHANGES)


def _new_number(f: dict):
    at = lambda step: _number([f], F.lit(0), step, _now(f))
    return lambda c: (c["step"] == 1) | (at(c["step"]) != at(c["step"] - 1))


def _other_level(f: dict, x: Column):
    return lambda c: x.isNull() | (x.cast("string") != _level(f, c["step"]))


def _level(f: dict, step: Column) -> Column:
    return F.element_at(F.array(*[F.lit(str(v)) for v in f.get("levels") or [""]]), step + 1)


def _number(fields: list[dict], field: Column, step: Column, now: Column) -> Column:
    """The value that a step leads to from ``now``; null for a categorical field."""
    out = F.lit(None).cast("double")
    for i, f in enumerate(fields):
        if _is_numeric(f):
            high = F.lit(float(f.get("max", 1.0)))
            v = F.when(step == CURVE_POINTS - 1, high).otherwise(now + step.cast("double") * ((high - now) / F.lit(float(CURVE_POINTS - 1))))
            out = F.when(field == i, F.rint(v) if f.get("integer") else v).otherwise(out)
    return out


def levers(df: DataFrame, key: str, scorer: Scorer, fields: list[dict], max_levers: int = MAX_LEVERS) -> DataFrame:
    """A3–A5: for records below the threshold, the smallest single change that
    reaches it. Numeric: first of 24 steps from the current value up to the
    training max; categorical: the best-scoring other level, if it reaches
    the threshold. Ranked by |to − from| (categorical last), keep 4.
    Columns: key, rank, column, from_value, to_value (text), to_number (numeric levers), gain.

    One explode of all changes of a record, one scoring of them, one aggregate. A change travels as two integers; what it changes is worked out
    from them, and a field's text only for the winners. The aggregate holds numbers only, so it is a hash aggregate that
    leaves one row a numeric field, and one a level that reaches the threshold, before the shuffle.
    """
    types = dict(df.dtypes)
    fields = [f for f in fields if f["name"] in df.columns]
    names = [f["name"] for f in fields]
    t = F.lit(float(scorer.threshold))
    field, step, now = F.col("_field"), F.col("_step"), F.col("_now")
    low = _scored(scorer, dealt(df.select(key, *names), work=CURVE_POINTS * len(names))).withColumnRenamed("_score", "_current").where(F.col("_current") < t)
    tried = low.select(key, "_current", F.explode(_steps(fields)).alias("_c"), *[F.col(f"`{n}`") for n in names])
    start = F.lit(None).cast("double")
    for i, f in enumerate(fields):
        if _is_numeric(f):
            start = F.when(F.col("_c.field") == i, _now(f)).otherwise(start)
    tried = tried.select(key, "_current", F.col("_c.field").alias("_field"), F.col("_c.step").alias("_step"), start.alias("_now"), *[F.col(f"`{n}`") for n in names])
    tried = tried.withColumn("_number", _number(fields, field, step, now))
    swapped = []
    for i, (n, f) in enumerate(zip(names, fields)):
        new = F.col("_number") if _is_numeric(f) else _level(f, F.when(field == i, step).otherwise(0))
        swapped.append(F.when(field == i, new.cast(types[n])).otherwise(F.col(f"`{n}`")).alias(n))
    scored = _once(_scored(scorer, _once(tried.select(key, "_current", "_field", "_step", "_now", *swapped))))
    # numeric: the first step that reaches the threshold; categorical: the best level, if it does
    level = F.when(now.isNull(), step).otherwise(-1)
    reached = (scored.where((F.col("_score") >= t) & (F.col("_score") > F.col("_current"))).groupBy(key, "_field", level.alias("_level"))
               .agg(F.min_by("_score", "_step").alias("_score"), F.min("_step").alias("_step"), F.max("_current").alias("_current"), F.max("_now").alias("_now")))
    best = reached.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_field").orderBy(F.desc("_score"), "_step"))).where("_place = 1")
    number = _number(fields, field, step, now)
    distance = F.when(now.isNotNull(), F.abs(number - now)).otherwise(F.lit(NON_NUMERIC_DISTANCE))
    w = Window.partitionBy(key).orderBy("_dist", "_field")
    ranked = best.withColumn("_dist", distance).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_levers)
    text, was = number.cast("string"), now.cast("string")
    for i, f in enumerate(fields):
        if not _is_numeric(f):
            text = F.when(field == i, _level(f, F.when(field == i, step).otherwise(0))).otherwise(text)
            was = F.when(field == i, F.col(f"_was_{i}")).otherwise(was)
    before = df.select(key, *[F.col(f"`{f['name']}`").cast("string").alias(f"_was_{i}") for i, f in enumerate(fields) if not _is_numeric(f)])
    if any(not _is_numeric(f) for f in fields):
        ranked = ranked.join(before, key)
    return ranked.select(key, "rank", F.element_at(F.array(*map(F.lit, names)), field + 1).alias("column"), was.alias("from_value"), text.alias("to_value"),
                         number.alias("to_number"), np_round(F.col("_score") - F.col("_current"), 4).alias("gain"))
