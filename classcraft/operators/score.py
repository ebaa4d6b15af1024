"""Batch scoring (SC1–SC7).

A ``Scorer`` carries the class labels, the positive class, the fitted
threshold, and a ``transform`` that adds a ``probs`` array (aligned with the
labels) to any DataFrame — either a fitted MLlib chain or a fixed formula.
Scoring is a single narrow projection over the input; nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classcraft.functions.expr import np_round
from classcraft.operators.metrics import argmax_label, renormalize

BORDERLINE_MARGIN = 0.10
CONFIDENT_MARGIN = 0.30
HISTOGRAM_BINS = 40
INPUT = "__input_row"
# The confidence band names.
BANDS = ("Borderline", "Moderate confidence", "High confidence")


@dataclass
class Scorer:
    labels: list[str]
    positive: str | None
    threshold: float
    transform: Callable[[DataFrame], DataFrame]
    input_schema: list[dict] = field(default_factory=list)

    @property
    def binary(self) -> bool:
        return len(self.labels) == 2 and self.positive in self.labels

    def probs(self, df: DataFrame) -> DataFrame:
        """SC1 core: add renormalised ``probs`` (M1)."""
        out = self.transform(df)
        return out.withColumn("probs", renormalize(F.col("probs")))

    def score_col(self) -> Column:
        """The record's score: positive-class p (binary) or the top label's p."""
        if self.binary:
            return F.element_at(F.col("probs"), self.labels.index(self.positive) + 1)
        return F.array_max(F.col("probs"))

    def score_of(self, raw: str) -> Column:
        """The score from the probabilities as ``transform`` gives them: one division instead of a renormalised array."""
        probs = F.col(raw)
        if not self.binary:
            return F.array_max(renormalize(probs))
        total = F.aggregate(probs, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(total > 0, F.element_at(probs, self.labels.index(self.positive) + 1) / total).when(
            probs.isNotNull(), F.lit(1.0) / F.size(probs).cast("double"))


def formula_scorer(threshold: float = 0.5) -> Scorer:
    """Fixed-formula stand-in for a fitted model over `records` (labels sorted)."""
    from classcraft.sources.tables import FORMULA_SCORE_SQL

    def transform(df: DataFrame) -> DataFrame:
        p = F.expr(FORMULA_SCORE_SQL)
        return df.withColumn("probs", F.array(p, F.lit(1.0) - p))

    return Scorer(["approved", "rejected"], "approved", threshold, transform)


def label_expr(scorer: Scorer) -> Column:
    """SC2 (binary: positive iff p ≥ threshold) / SC3 (argmax, first on ties)."""
    if scorer.binary:
        neg = next(label for label in scorer.labels if label != scorer.positive)
        return F.when(scorer.score_col() >= F.lit(scorer.threshold), F.lit(scorer.positive)).otherwise(F.lit(neg))
    return argmax_label(F.col("probs"), scorer.labels)


def band_expr(score: Column, threshold: float) -> Column:
    """SC5: confidence band from the unrounded margin |p − t|."""
    margin = F.abs(score - F.lit(threshold))
    return (F.when(margin < BORDERLINE_MARGIN, F.lit(BANDS[0]))
            .when(margin >= CONFIDENT_MARGIN, F.lit(BANDS[2]))
            .otherwise(F.lit(BANDS[1])))


def score_frame(df: DataFrame, scorer: Scorer) -> DataFrame:
    """SC1–SC5: input columns + prediction, p_<label> (4 dp), probability (4 dp), confidence."""
    # the caller's columns travel in a struct of their own, whatever names the model uses
    scored = scorer.probs(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(INPUT), "*"))
    per_label = [np_round(F.element_at(F.col("probs"), i + 1), 4).alias(f"p_{label}") for i, label in enumerate(scorer.labels)]
    s = scorer.score_col()
    return scored.select(
        f"{INPUT}.*",
        label_expr(scorer).alias("prediction"),
        *per_label,
        np_round(s, 4).alias("probability"),
        band_expr(s, scorer.threshold).alias("confidence"),
    )


def cohort_summary(scored: DataFrame, positive: str | None) -> DataFrame:
    """SC6: one row — total, positive rate (4 dp), mean probability (4 dp),
    borderline count — plus ``by_label`` as a map (one groupBy, tiny)."""
    head = scored.agg(
        F.count(F.lit(1)).alias("total"),
        (np_round(F.avg((F.col("prediction") == F.lit(positive)).cast("double")), 4) if positive else F.lit(None).cast("double")).alias("positive_rate"),
        np_round(F.avg("probability"), 4).alias("mean_probability"),
        F.count_if(F.col("confidence") == BANDS[0]).alias("borderline"),
    )
    return head


def label_counts(scored: DataFrame) -> DataFrame:
    """SC6 (by label): rows per predicted label."""
    return scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


def probability_histogram(df: DataFrame, column: str = "probability", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """SC7: equal-width bins on [0, 1] (p = 1 goes to the last bin). (bin, n)."""
    b = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
