"""Quality by robust multivariate outliers: minimum covariance determinant per language and source.

Every text gives a vector of five transformed statistics. For each (language, source) the minimum covariance
determinant (MCD) looks for the `COVERAGE` share of vectors with the tightest spread, so that junk up to the rest of
the share neither moves the centre nor widens the spread. A text is rejected if its squared Mahalanobis distance from
its group's reweighted estimate, less the part that its length alone makes up (a long text is no bad one, but its
length explains other statistics), is over the chi-square quantile `CUTOFF`, and it lies on the junk side of the
centre in symbols, repeated lines or repeated words, or far off in the mean word length: an unusually clean text is
no outlier of quality.

Estimation starts from two rough estimates, as deterministic MCD does (medians with absolute deviations; the
spatial sign covariance), and concentrates: distances, then mean and covariance of the nearest `COVERAGE` share, until
no determinant falls. No step sorts or gathers a group. Distances fall into narrow bins, and one aggregate sums
count, vector and products by (group, bin); a running sum over a group's at most a few thousand bins then gives the
moments of the nearest share, the bin at its edge included whole. So a group of any size costs one pass a step.
Covariances get `FLOORS` squared on the diagonal, since many statistics are zero in most texts: a text with a
repeated line or a few symbols is no outlier even where its neighbours have none.

A (language, source) of fewer than `MIN_ROWS` texts joins the small ones of its language, these, if still few, the
small ones of all languages; if those are too few as well, the method rejects none of them.

Edge cases: a null text has no words; texts without words fail the base rule and take no part in the estimates;
null language or source is a value of its own; repeated rows count as often as they occur; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classcraft.llm.common import written

# White space between words, and the symbols that are counted.
_SPACE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats")
JUNK = ("symbols", "dup_lines", "repeats")
COVERAGE = 0.75
CUTOFF = 1 - 1e-4
FLOORS = (0.5, 0.25, 0.7, 0.7, 0.7)  # spread of each statistic that no group is held to be narrower than
MIN_ROWS = 50
MAX_STEPS = 12
BIN = 1 / 64          # width of the bins of statistics
DISTANCE_BINS = 128   # bins for each doubling of 1 + squared distance


# ---------------------------------------------------------------- statistics

def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, characters in words, symbols, repeated lines, words in repeated 3-word windows)."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, _SYMBOLS))
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(_SPACE):
            seen.add(line)
    repeat = 0
    if len(words) > 2:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
        _, which, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = counts[which] > 1
        covered = np.zeros(len(words), bool)
        for shift in range(3):
            covered[shift:len(words) - 2 + shift] |= twice
        repeat = int(covered.sum())
    return len(words), chars, symbols, again, repeat


def _statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for texts in batches:
        rows = np.array([statistics(t.as_py()) for t in texts], np.int64).reshape(-1, 5)
        yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(5)], names=names)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the five statistics, base_failed, z): z is null for texts without words."""
    statistics_of = F.arrow_udf("struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint>")(_statistics)
    base = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                       statistics_of("text").alias("s")).select("doc_id", "lang", "source", "s.*")
    per_100 = lambda c: F.log1p(100 * F.col(c) / F.col("n_words"))
    z = F.array(F.log1p("n_words"), F.log(F.col("word_chars") / F.col("n_words")), per_100("n_symbols"), per_100("n_dup_lines"),
                per_100("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.withColumn("base_failed", failed).withColumn("z", F.when(F.col("n_words") > 0, z))


def grouped(rows: DataFrame) -> DataFrame:
    """Add ``grp``: language and source, or what small ones are united to; null if even that is small."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    key = rows.withColumn("l", named("lang")).withColumn("s", named("source"))
    counts = (key.where("z IS NOT NULL").groupBy("l", "s").count()
              .withColumn("in_lang", F.sum(F.when(F.col("count") < MIN_ROWS, F.col("count"))).over(Window.partitionBy("l"))))
    small, rest = F.col("count") < MIN_ROWS, F.coalesce("in_lang", F.lit(0)) < MIN_ROWS
    total = F.sum(F.when(small & rest, F.col("count"))).over(Window.partitionBy())
    names = counts.withColumn("all", F.coalesce(total, F.lit(0))).select(
        "l", "s", F.when(~small, F.concat_ws("\x1f", "l", "s")).when(~rest, F.col("l"))
        .when(F.col("all") >= MIN_ROWS, F.lit("")).alias("grp"))
    return key.join(names, ["l", "s"], "left").drop("l", "s")


# ---------------------------------------------------------------- chi-square

def chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function by its series."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    i = 1
    while term > total * 1e-15:
        term *= x / (a + i)
        total += term
        i += 1
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def consistency(share: float, k: int) -> float:
    """Factor by which the covariance of the nearest ``share`` of a normal sample is too small."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


# ---------------------------------------------------------------- estimates, one row per (group, start)

K = len(FEATURES)
PAIRS = [(i, j) for i in range(K) for j in range(i, K)]
ESTIMATE = "grp string, start int, center array<double>, inverse array<double>, logdet double, length_variance double, n long"


def _moments():
    one = [F.count(F.lit(1)).alias("n")] + [F.sum(F.col("z")[i]).alias(f"s{i}") for i in range(K)]
    return one + [F.sum(F.col("z")[i] * F.col("z")[j]).alias(f"p{i}_{j}") for i, j in PAIRS]


def _added():
    return [F.sum(c).alias(c) for c in ["n"] + [f"s{i}" for i in range(K)] + [f"p{i}_{j}" for i, j in PAIRS]]


def _estimates(factor: float):
    """Moments -> centre and inverse of the floored covariance times ``factor``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(K)]) / r["n"]
                cov = np.zeros((K, K))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / r["n"] - mean[i] * mean[j]
                cov = cov * factor + np.diag(np.square(FLOORS))
                rows.append((r["grp"], int(r["start"]), mean.tolist(), np.linalg.inv(cov).ravel().tolist(),
                             float(np.linalg.slogdet(cov)[1]), float(cov[0, 0]), int(r["n"])))
            yield pd.DataFrame(rows, columns=["grp", "start", "center", "inverse", "logdet", "length_variance", "n"])
    return run


def _distance(z="z", center="center", inverse="inverse"):
    diff = [F.col(z)[i] - F.col(center)[i] for i in range(K)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + diff[i] * diff[j] * F.col(inverse)[i * K + j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def _middle(values: DataFrame) -> DataFrame:
    """Median of ``v`` by (grp, f), to the width of a bin, from counts of the bins."""
    bins = values.withColumn("bin", F.floor(F.col("v") / BIN)).groupBy("grp", "f", "bin").count()
    w = Window.partitionBy("grp", "f")
    through = bins.withColumn("upto", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
    return through.where(F.col("upto") * 2 >= F.col("all")).groupBy("grp", "f").agg(((F.min("bin") + 0.5) * BIN).alias("m"))


def _wide(long: DataFrame, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("f", "m")))  # five rows a group
    return long.groupBy("grp").agg(F.transform(ordered, lambda x: x["m"]).alias(name))


def _starts(rows: DataFrame) -> DataFrame:
    """Two rough estimates a group: medians with absolute deviations, and the spatial sign covariance around them."""
    long = rows.select("grp", F.posexplode("z").alias("f", "v"))
    centers = written(_wide(_middle(long), "center"), "mcd-center")
    off = rows.join(centers, "grp").select("grp", F.posexplode(F.zip_with("z", "center", lambda a, b: F.abs(a - b))).alias("f", "v"))
    spreads = _wide(_middle(off), "spread")
    rough = written(centers.join(spreads, "grp"), "mcd-rough")
    scaled = F.transform(F.arrays_zip("z", "center", "spread", "floor"),
                         lambda x: (x["z"] - x["center"]) / F.sqrt(x["spread"] * x["spread"] * 2.2 + x["floor"] * x["floor"]))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    signs = (rows.join(rough, "grp").withColumn("floor", F.array(*map(F.lit, FLOORS))).withColumn("u", scaled).withColumn("norm", norm)
             .withColumn("z", F.when(F.col("norm") > 0, F.transform("u", lambda x: x / F.col("norm"))).otherwise(F.transform("u", lambda x: F.lit(0.0)))))
    sums = signs.groupBy("grp").agg(*_moments()).join(rough, "grp")

    def run(batches):
        for frame in batches:
            out = []
            for r in frame.to_dict("records"):
                sd = np.sqrt(np.square(np.array(r["spread"])) * 2.2 + np.square(FLOORS))  # 1.4826 squared
                sign = np.eye(K) * 1e-3
                for i, j in PAIRS:
                    sign[i, j] += r[f"p{i}_{j}"] / r["n"]
                    sign[j, i] = sign[i, j]
                for start, cov in ((0, np.diag(sd ** 2)), (1, sign * np.outer(sd, sd) * K)):
                    out.append((r["grp"], start, list(r["center"]), np.linalg.inv(cov).ravel().tolist(), float("inf"), float(cov[0, 0]), int(r["n"])))
            yield pd.DataFrame(out, columns=["grp", "start", "center", "inverse", "logdet", "length_variance", "n"])
    return sums.mapInPandas(run, ESTIMATE)


def _concentrated(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Estimates from the nearest COVERAGE share of every (group, start)."""
    d2 = rows.join(state.select("grp", "start", "center", "inverse"), "grp").withColumn("bin", F.floor(F.log2(1 + _distance()) * DISTANCE_BINS))
    bins = d2.groupBy("grp", "start", "bin").agg(*_moments())
    w = Window.partitionBy("grp", "start")
    near = (bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
            .where(F.col("upto") - F.col("n") < F.col("all") * COVERAGE))
    return near.groupBy("grp", "start").agg(*_added()).mapInPandas(_estimates(1.0), ESTIMATE)


def fit(rows: DataFrame) -> DataFrame:
    """(grp, center, inverse): the reweighted MCD estimate of every group of ``rows`` (grp, z)."""
    state, best = written(_starts(rows), "mcd-start"), None
    for _ in range(MAX_STEPS):
        state = written(_concentrated(rows, state), "mcd-step")
        now = state.agg(F.sum("logdet")).first()[0]
        if now is None or best is not None and best - now <= 1e-6 * max(1, abs(best)):
            break
        best = now
    raw = state.groupBy("grp").agg(F.min_by(F.struct("start", "center", "inverse"), F.struct("logdet", "start")).alias("e")).select("grp", "e.*")
    factor, cut = consistency(COVERAGE, K), chi2_quantile(0.975, K)
    inside = rows.join(raw, "grp").where(_distance() <= cut * factor)
    return written(inside.groupBy("grp", "start").agg(*_moments()).mapInPandas(_estimates(consistency(0.975, K)), ESTIMATE), "mcd")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, the statistics, base_failed, distance, outlier, kept); distance is null where there is no estimate."""
    rows = written(grouped(measured(docs)), "quality")
    usable = rows.where("grp IS NOT NULL AND z IS NOT NULL").select("grp", "z")
    model = fit(usable).select("grp", "center", "inverse", "length_variance")
    over = [F.col("z")[i] - F.col("center")[i] for i in range(K)]
    by_length = over[0] * over[0] / F.col("length_variance")
    found = rows.join(model, "grp", "left").withColumn(
        "distance", F.when(F.col("center").isNotNull() & F.col("z").isNotNull(), F.greatest(_distance() - by_length, F.lit(0.0))))
    junk = F.lit(False)
    for name, one, floor in zip(FEATURES, over, FLOORS):
        junk = junk | (one > 2 * floor if name in JUNK else F.abs(one) > 2 * floor if name == "word_length" else F.lit(False))
    outlier = F.coalesce((F.col("distance") > chi2_quantile(CUTOFF, K - 1)) & junk, F.lit(False))
    return found.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        "distance", outlier.alias("outlier"), (~F.col("base_failed") & ~outlier).alias("kept"), "z")
