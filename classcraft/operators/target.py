"""Target analysis (P11–P15): candidate ranking, label description, positive
class, class balance and the trainability guard.

All of these work on small per-column or per-class rows (the profile, or a
``groupBy(target).count()``), so every rule is a column expression and the
only shuffle is the class count itself (map-side combined).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classcraft.functions.expr import NUMBER_PATTERN

# Words that make a column a plausible target, in priority order.
TARGET_NAME_HINTS = (
    "placement_status", "placed", "placement", "target", "label", "outcome",
    "result", "status", "churn", "converted", "approved", "selected", "hired",
)
# Tokens (trimmed, lowercased, spaces removed, '-' → '_') read
# as the "yes" and "no" side of a two-level target.
POSITIVE_TOKENS = (
    "yes", "y", "true", "t", "1", "placed", "pass", "passed", "success",
    "approved", "selected", "hired", "positive", "win", "won", "admitted",
)
NEGATIVE_TOKENS = (
    "no", "n", "false", "f", "0", "notplaced", "not_placed", "unplaced",
    "fail", "failed", "rejected", "negative", "loss", "lost", "denied",
)
MIN_ROWS_PER_CLASS = 5
MAX_MULTICLASS = 20
TOP_LEVELS = 20


def _hint_score(name: Column) -> Column:
    lowered = F.lower(name)
    expr = None
    for rank, hint in enumerate(TARGET_NAME_HINTS):
        cond_eq, cond_in = lowered == F.lit(hint), lowered.contains(hint)
        expr = (F.when(cond_eq, F.lit(100.0 - rank)) if expr is None else expr.when(cond_eq, F.lit(100.0 - rank)))
        expr = expr.when(cond_in, F.lit(60.0 - rank))
    return expr.otherwise(F.lit(0.0))


def target_candidates(prof: DataFrame, limit: int = 5) -> DataFrame:
    """Rank columns by how target-like they look; top ``limit``.

    Columns: column, score, rank.
    """
    n_cols = F.max("position").over(Window.partitionBy()) + 1  # one row per column: tiny
    score = (
        _hint_score(F.col("column"))
        + F.when(F.col("n_unique") == 2, F.lit(30.0)).when((F.col("n_unique") > 2) & (F.col("n_unique") <= 10), F.lit(10.0)).otherwise(F.lit(0.0))
        + F.col("position") / F.greatest(n_cols - 1, F.lit(1)) * 5.0
    )
    eligible = prof.withColumn("score", score).where(
        ~F.col("kind").isin("constant", "empty", "text", "datetime") & ~F.col("is_identifier") & (F.col("score") > 0)
    )
    ranked = eligible.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("column"))))
    return ranked.where(F.col("rank") <= limit).select("column", "score", "rank")


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per non-null class, as text (``value``, ``n``)."""
    return (
        df.where(F.col(target).isNotNull())
        .groupBy(F.col(target).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def describe_target(df: DataFrame, target: str) -> DataFrame:
    """Top-20 levels with counts, class count and task type.

    Columns: value, n, rank, n_classes, task_type. 2 classes → binary; 3–20
    classes of a non-float column → multiclass; otherwise regression. The
    class count is one distributed aggregate (a scalar), and the top levels
    use the salted two-stage top-k, so a continuous "target" with billions of
    distinct values never lands in one task.
    """
    from classcraft.operators.profile import top_k_per_column

    dtype = dict(df.dtypes)[target]
    is_float = dtype in ("float", "double") or dtype.startswith("decimal")
    counts = class_counts(df, target)
    k = counts.count()
    task = task_type(k, is_float)
    top = top_k_per_column(counts.withColumn("column", F.lit(target)), TOP_LEVELS, [F.desc("n"), F.asc("value")])
    return top.select("value", "n", "rank", F.lit(k).cast("bigint").alias("n_classes"), F.lit(task).alias("task_type"))


def task_type(n_classes: int, is_float: bool) -> str:
    if n_classes == 2:
        return "binary_classification"
    if 2 < n_classes <= MAX_MULTICLASS and not is_float:
        return "multiclass_classification"
    return "regression"


def _token(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), " ", ""), "-", "_")


def positive_class(levels: DataFrame) -> DataFrame:
    """Which of the levels means "the event happened".

    ``levels`` has ``value`` and ``n``. Unique positive-token match; else the
    counterpart of the only negative token (two levels); else the larger
    number when all parse; else the most frequent level. One-row result.
    """
    tok = _token(F.col("value"))
    is_pos = tok.isin(*POSITIVE_TOKENS).cast("int")
    is_neg = tok.isin(*NEGATIVE_TOKENS).cast("int")
    numeric = F.when(F.trim(F.col("value")).rlike(NUMBER_PATTERN), F.trim(F.col("value")).try_cast("double"))
    first = F.struct(-F.col("n"), F.col("value"))  # most frequent, then least
    agg = levels.agg(
        F.sum(is_pos).alias("n_pos"),
        F.sum(is_neg).alias("n_neg"),
        F.count(F.lit(1)).alias("n_levels"),
        F.min_by("value", F.when(is_pos == 1, first)).alias("pos"),
        F.min_by("value", F.when(is_neg == 0, first)).alias("not_neg"),
        F.count(numeric).alias("n_numeric"),
        F.min_by("value", F.struct(-numeric, first)).alias("num_max"),
        F.min_by("value", first).alias("mode"),
    )
    choice = (
        F.when(F.col("n_pos") == 1, F.col("pos"))
        .when((F.col("n_neg") == 1) & (F.col("n_levels") == 2), F.col("not_neg"))
        .when(F.col("n_numeric") == F.col("n_levels"), F.col("num_max"))
        .otherwise(F.col("mode"))
    )
    return agg.select(choice.alias("positive_class"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Per class count, share (%, 2 dp) and the imbalance gap in points."""
    counts = class_counts(df, target)
    total, low, high, k = counts.agg(F.sum("n"), F.min("n"), F.max("n"), F.count(F.lit(1))).first()
    gap = (high - low) / total * 100.0 if k > 1 else 0.0
    return counts.select("value", "n", F.bround(F.col("n") / F.lit(total) * 100.0, 2).alias("share"), F.lit(gap).alias("imbalance"))


def target_guard(df: DataFrame, target: str) -> DataFrame:
    """Reasons the target cannot be trained on (empty when it can).

    Rules in order: fewer than two classes; a continuous target; any class
    with fewer than 5 rows. Columns: rule, value, n.
    """
    spark = df.sparkSession
    dtype = dict(df.dtypes)[target]
    is_float = dtype in ("float", "double") or dtype.startswith("decimal")
    counts = class_counts(df, target)
    k = counts.count()
    schema = "rule string, value string, n bigint"
    if k < 2:
        return spark.createDataFrame([("single_class", None, k)], schema)
    if task_type(k, is_float) == "regression":
        return spark.createDataFrame([("continuous", None, k)], schema)
    return counts.where(F.col("n") < MIN_ROWS_PER_CLASS).select(F.lit("thin_class").alias("rule"), "value", F.col("n").cast("bigint").alias("n"))
