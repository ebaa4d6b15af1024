"""Exact order statistics, quantiles and modes at any size.

An order statistic is found by narrowing: count the values of a range in `BINS` equal bins, keep the bin that the
rank falls in with its own least and greatest value, and count again inside it until they are equal. A pass is a scan with a
map-side combined count of at most `BINS` rows a range, so no value is shuffled or buffered. Three passes settle most columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
LARGEST = 1.7976931348623157e308


def order_statistics(long: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """Values at the 0-based ``ranks`` of each group of ``long`` (g string, v double); ranks outside a group are left out.

    What reaches the driver is one row per group and rank.
    """
    spark = long.sparkSession
    rows = long.where(F.col("v").isNotNull() & ~F.isnan("v")).select(
        "g", F.greatest(F.least("v", F.lit(LARGEST)), F.lit(-LARGEST)).alias("v"))
    found: dict[str, dict[int, float]] = {g: {} for g in ranks}
    open_: list[tuple[str, float, float, int, list[int]]] = []

    def settle(g: str, low: float, high: float, before: int, wanted: list[int]) -> None:
        if low == high:
            found[g].update({r: low for r in wanted})
        else:
            open_.append((g, low, high, before, wanted))

    for r in rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).collect():
        wanted = sorted({k for k in ranks.get(r.g, []) if 0 <= k < r.n})
        if wanted:
            settle(r.g, r.low, r.high, 0, wanted)
    while open_:
        parts = [(i, *part) for i, part in enumerate(open_)]
        ranges = spark.createDataFrame(parts, "part int, g string, low double, high double, before long, wanted array<long>")
        width = F.col("high") / 2 - F.col("low") / 2
        share = (F.col("v") / 2 - F.col("low") / 2) / F.when(width > 0, width)
        place = F.when(F.col("v") >= F.col("high"), BINS - 1).otherwise(
            F.coalesce(F.least(F.floor(share * BINS), F.lit(BINS - 1)), F.lit(0)))
        inside = rows.join(F.broadcast(ranges), "g").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        bins = inside.groupBy("part", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        through = F.sum("n").over(Window.partitionBy("part").orderBy("bin"))
        sums = bins.withColumn("through", through).join(F.broadcast(ranges.select("part", "before", "wanted")), "part")
        start = F.col("before") + F.col("through") - F.col("n")
        hit = sums.select("part", "low", "high", start.alias("start"),
                          F.filter("wanted", lambda r: (r >= start) & (r < start + F.col("n"))).alias("mine")).where(F.size("mine") > 0)
        last, open_ = open_, []
        for r in hit.collect():
            settle(last[r.part][0], r.low, r.high, r.start, list(r.mine))
    return found


def _long(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(name).alias("g"), value.cast("double").alias("v")) for name, value in columns.items()])
    return df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("v").isNotNull() & ~F.isnan("v"))


def quantiles(df: DataFrame, columns: dict[str, Column], points: list[float]) -> dict[str, list[float] | None]:
    """Quantiles with linear interpolation of each named expression; None for one without values."""
    if not columns:
        return {}
    long = _long(df, columns)
    sizes = {r.g: r.n for r in long.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = {name: [(sizes[name] - 1) * q for q in points] for name in columns if name in sizes}
    ranks = {name: [k for p in at for k in (int(p), min(int(p) + 1, sizes[name] - 1))] for name, at in places.items()}
    values = order_statistics(long, ranks)
    out: dict[str, list[float] | None] = {name: None for name in columns}
    for name, at in places.items():
        have, top = values[name], sizes[name] - 1
        out[name] = [have[int(p)] + (have[min(int(p) + 1, top)] - have[int(p)]) * (p - int(p)) for p in at]
    return out


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    return {name: v[0] if v else None for name, v in quantiles(df, columns, [0.5]).items()}


def modes(df: DataFrame, columns: dict[str, tuple[Column, bool]]) -> dict[str, str | None]:
    """Most frequent value, as text, of each (expression, is numeric); ties go to the least value. Counts are combined
    before the shuffle and no buffer holds a column's values."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(name).alias("g"), value.cast("string").alias("text"),
                               (value.cast("double") if numeric else F.lit(None).cast("double")).alias("number"))
                      for name, (value, numeric) in columns.items()])
    counts = (df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("text").isNotNull())
              .groupBy("g", "text", "number").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("n"), "number", "text")).alias("b")).collect()
    return {name: None for name in columns} | {r.g: r.b.text for r in best}
