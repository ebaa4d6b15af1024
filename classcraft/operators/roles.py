"""Row filters and column roles.

F3's rules run as a ``when`` chain over the one-row-per-column profile, so
the roles table is a DataFrame that can be joined with user overrides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classcraft.operators.profile import MAX_CATEGORY_CARDINALITY, row_hashes
from classcraft.sources.io import canonical_names

SPARSE_MISSING_PCT = 60.0
ROLES = ("numeric_feature", "categorical_feature", "target", "identifier", "drop")


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """rows without a target value are removed."""
    return df.dropna(subset=[target])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """one row of each identical group stays, by the 128-bit hash of its columns (MAP columns are not compared)."""
    a, b = row_hashes(df)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), a.alias("a"), b.alias("b"))
    return whole.dropDuplicates(["a", "b"]).select("row.*")


def auto_roles(prof: DataFrame, target: str, overrides: dict[str, str] | None = None,
               leakage: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """column roles by shape, with user overrides winning.

    Columns: column, position, role, source ('rule' or 'user').
    """
    numeric_dtype = F.col("dtype").isin("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") | F.col("dtype").startswith("decimal")
    rule = (
        F.when(F.col("column") == F.lit(target), F.lit("target"))
        .when(F.col("is_identifier"), F.lit("identifier"))
        .when(F.col("kind").isin("constant", "empty", "text", "datetime"), F.lit("drop"))
        .when(F.col("missing_pct") > SPARSE_MISSING_PCT, F.lit("drop"))
        .when(F.col("kind") == "numeric", F.lit("numeric_feature"))
        .when(F.col("kind") == "boolean", F.when(numeric_dtype, F.lit("numeric_feature")).otherwise(F.lit("categorical_feature")))
        .when(F.col("n_unique") > MAX_CATEGORY_CARDINALITY, F.lit("drop"))
        .otherwise(F.lit("categorical_feature"))
    )
    out = prof.select("column", "position", rule.alias("rule_role"))
    overrides = {k: v for k, v in (overrides or {}).items() if v in ROLES}
    if overrides:
        o = prof.sparkSession.createDataFrame(list(overrides.items()), "column string, user_role string")
        out = out.join(F.broadcast(o), "column", "left")
    else:
        out = out.withColumn("user_role", F.lit(None).cast("string"))
    role = F.coalesce(F.col("user_role"), F.col("rule_role"))
    # A second "target" and any leakage-flagged feature are dropped.
    role = (
        F.when((role == "target") & (F.col("column") != F.lit(target)), F.lit("drop"))
        .when(F.col("column").isin(*leakage) if leakage else F.lit(False), F.lit("drop"))
        .when(F.col("column") == F.lit(target), F.lit("target"))
        .otherwise(role)
    )
    return out.select("column", "position", role.alias("role"),
                      F.when(F.col("user_role").isNotNull(), F.lit("user")).otherwise(F.lit("rule")).alias("source"))


def reconcile(df: DataFrame, expected: list[tuple[str, str]]) -> tuple[DataFrame, dict]:
    """align a table with the expected (name, type) columns.

    Headers that are not expected as they stand are canonicalised. Absent columns become typed NULLs, extra ones are
    dropped, and the order is the training order. Returns the projected frame and a report
    (expected / present / missing / extra / renamed / usable).
    """
    names = [c for c, _ in expected]
    canonical = canonical_names(df.columns)
    taken = set(df.columns)
    renamed = {c: canonical[c] for c in df.columns if c not in names and canonical[c] in names and canonical[c] not in taken}
    source = {renamed.get(c, c): c for c in df.columns}
    cols = [(F.col(f"`{source[c]}`") if c in source else F.lit(None)).cast(t).alias(c) for c, t in expected]
    present = [c for c in names if c in source]
    return df.select(*cols), {"expected": names, "present": present, "missing": [c for c in names if c not in source],
                              "extra": [c for c in source if c not in names], "renamed": renamed, "usable": bool(present)}


def fill_defaults(df: DataFrame, defaults: dict[str, object], keep: list[str] | None = None) -> DataFrame:
    """supply training-typical values for absent fields; unknown fields are ignored.

    A column that is present keeps its values (a supplied NULL stays NULL).
    """
    have = set(df.columns)
    passthrough = [F.col(f"`{c}`") for c in (keep or []) if c in have and c not in defaults]
    cols = [F.col(f"`{c}`") if c in have else F.lit(v).alias(c) for c, v in defaults.items()]
    return df.select(*passthrough, *cols)
