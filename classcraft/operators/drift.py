"""Population stability.

All columns are handled at once in long form: ``(column, value)`` rows from
one ``explode`` over the table, joined to a per-column baseline that is tiny
(≤ 11 edges or ≤ 50 level shares per column) and therefore broadcast. A bin
is the number of inner edges ≤ v — NumPy's histogram rule (bins [eᵢ, eᵢ₊₁),
outer edges open).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classcraft.operators import ranks
from classcraft.operators.profile import top_k_per_column

EPSILON = 1e-6
BUCKETS = 10
MIN_SAMPLES = 30
WATCH = 0.10
ALERT = 0.25
REST = "\u0001rest"  # the one bin of all levels that a cut baseline does not name
QUANTILES = [i / BUCKETS for i in range(BUCKETS + 1)]


def _long_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.*").where(F.col("v").isNotNull() & ~F.isnan("v"))


def _long_text(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.*").where(F.col("level").isNotNull())


def quantile_edges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct decile edges per numeric column (exact, linear interpolation). (column, edges), columns with two edges at least."""
    found = ranks.quantiles(df, {c: F.col(f"`{c}`").cast("double") for c in columns}, QUANTILES)
    rows = [(c, sorted(set(q))) for c, q in found.items() if q and len(set(q)) > 1]
    return df.sparkSession.createDataFrame(rows, "column string, edges array<double>")


def _bin(edges: Column, v: Column) -> Column:
    inner = F.slice(edges, 2, F.size(edges) - 2)
    return F.size(F.filter(inner, lambda e: e <= v))


def _bin_shares(long: DataFrame, edges: DataFrame) -> DataFrame:
    """(column, bin, share) of the values in ``long`` over the given edges (all bins, zeros kept)."""
    binned = long.join(F.broadcast(edges), "column").select("column", _bin(F.col("edges"), F.col("v")).alias("bin"))
    counts = binned.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    bins = edges.select("column", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    return (bins.join(counts, ["column", "bin"], "left").join(F.broadcast(totals), "column")
            .select("column", "bin", (F.coalesce(F.col("n"), F.lit(0)) / F.col("total")).alias("share")))


def numeric_baseline(train: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column, stored edges (6 dp) and true bin shares (6 dp),
    counted on the unrounded edges. Columns: column, edges, shares."""
    edges = quantile_edges(train, columns)
    shares = _bin_shares(_long_numeric(train, columns), edges)
    packed = shares.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("bin", "share"))).alias("s"))
    out = edges.join(packed, "column").select(
        "column",
        F.transform("edges", lambda e: F.round(e, 6)).alias("edges"),
        F.transform("s", lambda x: F.round(x["share"], 6)).alias("shares"),
    )
    return out


def level_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, level, share) of non-null values, as text."""
    counts = _long_text(df, columns).groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "column").select("column", "level", (F.col("n") / F.col("total")).alias("share"), "n")


def categorical_baseline(train: DataFrame, columns: list[str], top: int | None = None, rest: bool = False) -> DataFrame:
    """Level shares per categorical column, 6 dp. (column, level, share).

    All levels, or the ``top`` most frequent; with ``rest`` those beyond are one further level, `REST`, and the PSI against
    such a baseline counts every unnamed recent level there too.
    """
    s = level_shares(train, columns)
    if top is None:
        return s.select("column", "level", F.round("share", 6).alias("share"))
    named = top_k_per_column(s.withColumnRenamed("level", "value"), top, [F.desc("n"), F.asc("value")]).select(
        "column", F.col("value").alias("level"), "share")
    if rest:
        named = named.unionByName(named.groupBy("column").agg((1 - F.sum("share")).alias("share")).select("column", F.lit(REST).alias("level"), "share"))
    return named.select("column", "level", F.round("share", 6).alias("share"))


def _psi_terms(base: Column, new: Column) -> Column:
    b = F.greatest(F.coalesce(base, F.lit(0.0)), F.lit(EPSILON))
    n = F.greatest(F.coalesce(new, F.lit(0.0)), F.lit(EPSILON))
    return (n - b) * F.log(n / b)


def _psi(paired: DataFrame) -> DataFrame:
    """(column, psi, compared): PSI of the paired shares base and new; 0.0 and not compared if a side has no values at all."""
    both = (F.count("base") > 0) & (F.count("new") > 0)
    return paired.groupBy("column").agg(F.when(both, F.sum(_psi_terms(F.col("base"), F.col("new")))).otherwise(0.0).alias("psi"), both.alias("compared"))


def _edges_psi(recent: DataFrame, baseline: DataFrame) -> DataFrame:
    usable = baseline.where((F.size("edges") >= 2) & (F.size("shares") == F.size("edges") - 1))
    stored = [r for r in usable.collect() if r["column"] in recent.columns]  # one row a column
    local = recent.sparkSession.createDataFrame([(r["column"], r["edges"], r["shares"]) for r in stored],
                                                "column string, edges array<double>, shares array<double>")
    if not stored:
        return local.select("column", F.lit(0.0).alias("psi"), F.lit(False).alias("compared"))
    new = _bin_shares(_long_numeric(recent, [r["column"] for r in stored]), local.select("column", "edges"))
    base = local.select("column", F.posexplode("shares").alias("bin", "base"))
    return _psi(base.join(new.withColumnRenamed("share", "new"), ["column", "bin"], "left"))


def _shares_psi(recent: DataFrame, shares: DataFrame) -> DataFrame:
    names = [r["column"] for r in shares.select("column").distinct().collect() if r["column"] in recent.columns]
    if not names:
        return shares.select("column", F.lit(0.0).alias("psi"), F.lit(False).alias("compared")).limit(0)
    base = shares.where(F.col("column").isin(*names)).select("column", "level", F.col("share").alias("base"))
    new = level_shares(recent, names).select("column", "level", F.col("share").alias("new"))
    cut = base.where(F.col("level") == REST).select("column", F.lit(True).alias("cut"))
    if not cut.isEmpty():
        known = base.select("column", "level", F.lit(True).alias("known"))
        folded = new.join(F.broadcast(cut), "column", "left").join(known, ["column", "level"], "left")
        level = F.when(F.col("cut") & F.col("known").isNull(), F.lit(REST)).otherwise(F.col("level"))
        new = folded.groupBy("column", level.alias("level")).agg(F.sum("new").alias("new"))
    return _psi(base.join(new, ["column", "level"], "full_outer"))


def psi_from_edges(recent: DataFrame, baseline: DataFrame) -> DataFrame:
    """PSI of recent values against stored edges and shares, 0.0 without recent values. (column, psi)."""
    return _edges_psi(recent, baseline).select("column", "psi")


def psi_from_shares(recent: DataFrame, shares: DataFrame) -> DataFrame:
    """PSI of recent levels against stored level shares (union of levels), 0.0 without recent values. (column, psi)."""
    return _shares_psi(recent, shares).select("column", "psi")


def _all_named(psi: DataFrame, columns: list[str]) -> DataFrame:
    """A row for every column, 0.0 where nothing could be compared."""
    names = psi.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(psi, "column", "left").select("column", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def psi_numeric(base_df: DataFrame, recent: DataFrame, columns: list[str]) -> DataFrame:
    """D3: two-sample PSI, deciles cut on the base sample (unrounded edges); 0.0 if a sample has no values or one value."""
    edges = quantile_edges(base_df, columns)
    b = _bin_shares(_long_numeric(base_df, columns), edges).withColumnRenamed("share", "base")
    n = _bin_shares(_long_numeric(recent, columns), edges).withColumnRenamed("share", "new")
    return _all_named(_psi(b.join(n, ["column", "bin"], "left")), columns)


def psi_categorical(base_df: DataFrame, recent: DataFrame, columns: list[str]) -> DataFrame:
    """Two-sample PSI over the union of observed levels; 0.0 if a sample has no values."""
    base = level_shares(base_df, columns).select("column", "level", "share")
    return _all_named(psi_from_shares(recent, base), columns)


def status(psi: Column) -> Column:
    """Alert ≥ 0.25, watch ≥ 0.10, else ok (from the unrounded PSI)."""
    return F.when(psi >= ALERT, F.lit("alert")).when(psi >= WATCH, F.lit("watch")).otherwise(F.lit("ok"))


def drift_report(recent: DataFrame, numeric_base: DataFrame | None, level_base: DataFrame | None) -> DataFrame:
    """Per column PSI (4 dp) and status, most drifted first, plus the
    overall status (the worst column's) on every row.

    ``insufficient_data`` under 30 rows; ``unavailable`` with no baseline or
    no comparable column (one row, column NULL). A column without recent values is not compared.
    Columns: column, psi, status, overall, n_recent.
    """
    spark = recent.sparkSession
    schema = "column string, psi double, status string, overall string, n_recent bigint"
    n = recent.count()
    if numeric_base is None and level_base is None:
        return spark.createDataFrame([(None, None, None, "unavailable", n)], schema)
    if n < MIN_SAMPLES:
        return spark.createDataFrame([(None, None, None, "insufficient_data", n)], schema)
    parts = []
    if numeric_base is not None:
        parts.append(_edges_psi(recent, numeric_base))
    if level_base is not None:
        parts.append(_shares_psi(recent, level_base))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    rows = allp.where("compared").select("column", F.round("psi", 4).alias("psi"), status(F.col("psi")).alias("status")).collect()
    if not rows:
        return spark.createDataFrame([(None, None, None, "unavailable", n)], schema)
    ordered = sorted(rows, key=lambda r: -r["psi"])  # one row per column
    overall = ordered[0]["status"]
    return spark.createDataFrame([(r["column"], r["psi"], r["status"], overall, n) for r in ordered], schema)
