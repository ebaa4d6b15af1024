"""Column profiling.

One wide aggregate gives the row and missing counts, moments, integrality and the numeric-like test of every column
(P1, P4, P5, P8) and one exact count of distinct 128-bit hashes the distinct counts (P2): cells are hashed before
they are shuffled, so no text moves. Medians come from `ranks` by narrowing. Each step is run only if its result is
asked for, and what reaches the driver is one row per column, which is the profile: later steps read it, not the table.

The texts of cells are only counted for the columns that can be categorical (P6). The kind (P3) and identifier (P9)
rules are ``when`` chains over the per-column rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classcraft.functions.expr import is_integer_type, is_numeric_type, parse_number, strip_ws
from classcraft.operators import ranks

# Fixed values of the profiling rules.
MAX_CATEGORY_CARDINALITY = 50
IDENTIFIER_UNIQUE_RATIO = 0.95
IDENTIFIER_SUFFIXES = ("_id", "_no", "_number")
IDENTIFIER_NAMES = ("id", "index", "sl_no", "serial", "roll", "roll_no", "uid")
TOP_VALUES = 10
SAMPLE_VALUES = 6
# Salt buckets for the two-stage top-k (bounds the rows per window task).
TOPK_BUCKETS = 64

_NESTED = ("array", "map", "struct")


def _is_nested(dtype: str) -> bool:
    return dtype.startswith(_NESTED)


def _as_text(c: str, dtype: str) -> Column:
    x = F.col(f"`{c}`")
    if _is_nested(dtype):
        return F.to_json(x)
    if dtype in ("float", "double"):
        return F.when(~F.isnan(x), x.cast("string"))
    return x.cast("string")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form ``(column, position, value, n)``: one row per distinct non-null value of the named columns."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), _as_text(c, t).alias("value"))
        for i, (c, t) in enumerate(df.dtypes) if c in set(columns)
    ]
    return (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*")
        .where(F.col("value").isNotNull())
        .groupBy("column", "position", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_k_per_column(counts: DataFrame, k: int, order: list[Column], buckets: int = TOPK_BUCKETS) -> DataFrame:
    """Exact top-k per column in two window stages over salted buckets.

    Stage 1 keeps the best ``k`` rows of each ``(column, hash bucket)``; every
    global top-k row survives it, and stage 2 ranks at most ``k * buckets``
    rows per column — no task ever holds all distinct values of a column.
    """
    salted = counts.withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    w1 = Window.partitionBy("column", "_b").orderBy(*order)
    w2 = Window.partitionBy("column").orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(w1))
        .where(F.col("_r") <= k)
        .withColumn("rank", F.row_number().over(w2))
        .where(F.col("rank") <= k)
        .drop("_b", "_r")
    )


def _is_missing(c: str, dtype: str) -> Column:
    x = F.col(f"`{c}`")
    return x.isNull() | F.isnan(x) if dtype in ("float", "double") else x.isNull()


def _number(c: str, dtype: str) -> Column:
    """The cell as a double, null if it is missing or its column is neither numeric nor boolean."""
    if is_numeric_type(dtype) or dtype == "boolean":
        v = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(v), v)
    return F.lit(None).cast("double")


def _column_stats(c: str, dtype: str) -> Column:
    x, v = F.col(f"`{c}`"), _number(c, dtype)
    whole = is_integer_type(dtype) or dtype == "boolean"
    integral = F.lit(True) if whole else F.coalesce(F.bool_and(F.when(v.isNotNull(), v % 1 == 0)), F.lit(False))
    numeric_like = F.lit(False)
    if dtype == "string":
        parsed = parse_number(F.regexp_replace(strip_ws(x), ",", "")).isNotNull().cast("double")
        numeric_like = F.coalesce(F.avg(F.when(x.isNotNull(), parsed)) > 0.9, F.lit(False))
    return F.struct(
        F.count_if(_is_missing(c, dtype)).alias("n_missing"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v), F.when(F.count(v) > 0, F.lit(0.0))).alias("std"),
        integral.alias("is_integral"), F.count(v).alias("n_numeric"), numeric_like.alias("numeric_like"))


def missing_counts(df: DataFrame) -> DataFrame:
    """P1 alone: (column, n_rows, n_missing, missing_pct) from one aggregate."""
    each = [F.struct(F.lit(c).alias("column"), F.count_if(_is_missing(c, t)).alias("n_missing")) for c, t in df.dtypes]
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*each).alias("c")).select("n_rows", F.explode("c").alias("c"))
    n = F.col("n_rows")
    return rows.select("c.column", "n_rows", "c.n_missing",
                       F.when(n > 0, F.col("c.n_missing") / n * 100.0).otherwise(0.0).alias("missing_pct"))


def numeric_like(df: DataFrame) -> DataFrame:
    """P8 alone: (column, numeric_like) from one aggregate."""
    each = [F.struct(F.lit(c).alias("column"), _column_stats(c, t)["numeric_like"].alias("numeric_like")) for c, t in df.dtypes]
    return df.agg(F.array(*each).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def distinct_counts(df: DataFrame) -> dict[str, int]:
    """Exact number of distinct non-missing cells by column, counted on 128-bit hashes."""
    cells = []
    for i, (c, t) in enumerate(df.dtypes):
        x = F.to_json(F.col(f"`{c}`")) if _is_nested(t) else F.col(f"`{c}`")
        cells.append(F.when(~_is_missing(c, t), F.struct(F.lit(i).alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))
    found = (df.select(F.explode(F.array_compact(F.array(*cells))).alias("h")).select("h.*").distinct()
             .groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect())
    return dict.fromkeys(df.columns, 0) | {df.columns[r.i]: r.n for r in found}


PROFILE_SCHEMA = ("column string, position int, dtype string, n_rows bigint, n_missing bigint, n_unique bigint, minimum double, maximum double, "
                  "mean double, std double, median double, is_integral boolean, n_numeric bigint, numeric_like boolean")


def profile(df: DataFrame, median: bool = True) -> DataFrame:
    """One row per column: counts, kind, moments, flags.

    Columns: column, position, dtype, n_rows, n_missing, missing_pct, n_unique, unique_ratio, kind, minimum, maximum, mean,
    std, median (null unless asked for), is_integral, numeric_like, is_identifier. The rows are computed here, once.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), *[_column_stats(c, t).alias(f"c{i}") for i, (c, t) in enumerate(df.dtypes)]).first()
    unique = distinct_counts(df)
    medians = ranks.medians(df, {c: _number(c, t) for c, t in df.dtypes if is_numeric_type(t) or t == "boolean"}) if median else {}
    rows = []
    for i, (c, t) in enumerate(df.dtypes):
        s = row[f"c{i}"]
        rows.append((c, i, t, row["n"], s["n_missing"], unique[c], s["minimum"], s["maximum"], s["mean"], s["std"], medians.get(c),
                     s["is_integral"], s["n_numeric"], s["numeric_like"]))
    return classify_columns(df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA))


def classify_columns(p: DataFrame) -> DataFrame:
    """Kind (P3), missing share, unique ratio and identifier flag (P9) as expressions."""
    n = F.col("n_rows")
    nu = F.col("n_unique")
    dtype = F.col("dtype")
    numeric_dtype = dtype.isin("tinyint", "smallint", "int", "bigint", "float", "double") | dtype.startswith("decimal")
    ratio = F.when(n > 0, nu / n).otherwise(F.lit(0.0))
    kind = (
        F.when(F.col("n_missing") == n, F.lit("empty"))
        .when(nu <= 1, F.lit("constant"))
        .when(dtype == "boolean", F.lit("boolean"))
        .when(dtype.startswith("timestamp") | (dtype == "date"), F.lit("datetime"))
        .when(numeric_dtype, F.when(nu == 2, F.lit("boolean")).otherwise(F.lit("numeric")))
        .when(dtype.startswith("array") | dtype.startswith("map") | dtype.startswith("struct"), F.lit("text"))
        .when((nu <= MAX_CATEGORY_CARDINALITY) | ((n > 0) & (ratio < 0.5)), F.lit("categorical"))
        .otherwise(F.lit("text"))
    )
    out = p.withColumn("kind", kind).withColumn("unique_ratio", ratio)
    measured = F.col("kind").isin("numeric", "boolean") & (F.col("n_numeric") > 0)
    for c in ("minimum", "maximum", "mean", "std", "median"):
        out = out.withColumn(c, F.when(measured, F.col(c)))
    out = out.withColumn("is_integral", F.when(measured, F.col("is_integral")).otherwise(F.lit(False)))
    could_be_id = F.col("is_integral") | ~F.col("kind").isin("numeric", "boolean")
    name = F.col("column")
    suffix = F.lit(False)
    for s in IDENTIFIER_SUFFIXES:
        suffix = suffix | name.endswith(s)
    identifier = (
        (could_be_id & (F.col("unique_ratio") >= IDENTIFIER_UNIQUE_RATIO) & (n > 20))
        | suffix
        | name.isin(*IDENTIFIER_NAMES)
    )
    numeric_like = F.col("numeric_like") & ~(numeric_dtype | (dtype == "boolean"))
    return out.select(
        "column", "position", "dtype", "n_rows", "n_missing",
        F.when(n > 0, F.col("n_missing") / n * 100.0).otherwise(F.lit(0.0)).alias("missing_pct"),
        "n_unique", "unique_ratio", "kind", "minimum", "maximum", "mean", "std", "median",
        "is_integral", numeric_like.alias("numeric_like"), identifier.alias("is_identifier"),
    )


def top_values(df: DataFrame, prof: DataFrame | None = None, k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent levels of categorical/boolean/constant columns.

    Ties are broken by value ascending. Only these columns are counted. Columns: column, rank, value, n.
    """
    prof = profile(df, median=False) if prof is None else prof
    kinds = prof.where(F.col("kind").isin("categorical", "boolean", "constant")).select("column")
    counts = value_counts(df, [r["column"] for r in kinds.collect()])
    return top_k_per_column(counts, k, [F.desc("n"), F.asc("value")]).select("column", "rank", "value", "n")


def sample_values(df: DataFrame, k: int = SAMPLE_VALUES) -> DataFrame:
    """The first k distinct non-null values of every column, by value.

    The next value is the least one greater than the last, so k wide aggregates find them and nothing is shuffled.
    """
    texts = {c: _as_text(c, t) for c, t in df.dtypes}
    last: dict[str, str | None] = dict.fromkeys(texts)
    rows = []
    for rank in range(1, k + 1):
        live = [c for c in texts if rank == 1 or last[c] is not None]
        if not live:
            break
        found = df.agg(*[F.min(texts[c] if last[c] is None else F.when(texts[c] > F.lit(last[c]), texts[c])).alias(f"m{i}") for i, c in enumerate(live)]).first()
        last = dict.fromkeys(texts) | {c: found[f"m{i}"] for i, c in enumerate(live)}
        rows += [(c, rank, last[c]) for c in live if last[c] is not None]
    return df.sparkSession.createDataFrame(rows, "column string, rank int, value string")


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row's columns, nulls told apart; MAP columns, which cannot be compared, are left out."""
    cells = [x for c, t in df.dtypes if not t.startswith("map") for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(F.lit(0), *cells), F.xxhash64(F.lit(1), *cells)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """P10: number of rows beyond the first of each identical group; hashes are shuffled, not rows."""
    a, b = row_hashes(df)
    groups = df.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def profile_rows(prof: DataFrame) -> list[dict]:
    """Collect the (one-row-per-column) profile for driver-side planning."""
    return [r.asDict() for r in prof.orderBy("position").collect()]
