"""Classification metrics (M1–M16) over scored rows.

Binary input: ``y`` (1 = positive class, 0 = other) and ``p`` (positive-class
probability). Multiclass input: ``y`` (label text) and ``probs`` (array of
probabilities aligned with a ``labels`` list).

Every curve metric rests on one primitive, ``score_curve``: per distinct
score, the counts at that score and the cumulative counts at or above it.
It never uses an unpartitioned window (which would put every row on one
task): scores are grouped (map-side combined), dealt to sampled ranges,
range totals are cumulated (one row per range and class) and broadcast back as
offsets, and the running sum is taken inside each range only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classcraft.session import ensure_checkpoint_dir

EPS = 2.220446049250313e-16
CURVE_POINTS = 200


# ── M1 ─────────────────────────────────────────────────────────────────────
def renormalize(probs: Column) -> Column:
    """M1: scale a probability array to sum 1; an all-zero row becomes uniform."""
    total = F.aggregate(probs, F.lit(0.0), lambda acc, x: acc + x)
    k = F.size(probs).cast("double")
    return F.when(total > 0, F.transform(probs, lambda x: x / total)).otherwise(
        F.transform(probs, lambda x: F.lit(1.0) / k))


# ── cumulative-count primitive ─────────────────────────────────────────────
def running_totals(df: DataFrame, order_col: str, sums: list[str], by: list[str] | tuple = ()) -> DataFrame:
    """Inclusive running sums of ``sums`` in descending ``order_col`` per ``by`` group.

    ``df`` must hold one row per (by, order value). The rows are dealt to ranges of (by, order value) by sampled bounds, so
    a range holds a bounded share of the rows whatever the values are; the written ranges keep their numbers, their totals are
    summed up (one row per range and group) and broadcast as offsets, and the running sum is taken inside each range only.
    """
    by = list(by)
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = df.repartitionByRange(ranges, *by, F.desc(order_col)).withColumn("_b", F.spark_partition_id())
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/curve-{uuid.uuid4().hex}"
    dealt.write.parquet(path)
    with_b = spark.read.schema(dealt.schema).parquet(path)
    totals = with_b.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    wb = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{s}").over(wb), F.lit(0)).alias(f"_o_{s}") for s in sums])
    w = Window.partitionBy(*by, "_b").orderBy(F.desc(order_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = with_b.join(F.broadcast(offsets), [*by, "_b"])
    return joined.select(
        *[c for c in df.columns],
        *[(F.sum(s).over(w) + F.col(f"_o_{s}")).alias(f"c{s}") for s in sums],
    )


def score_curve(df: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Per distinct score ``p``: tp, fp (rows at that score), ctp, cfp (rows at
    or above it), and the class totals P and N of the group."""
    by = list(by)
    g = df.groupBy(*by, "p").agg(
        F.sum(F.col("y").cast("long")).alias("tp"),
        F.sum((1 - F.col("y")).cast("long")).alias("fp"),
    )
    cur = running_totals(g, "p", ["tp", "fp"], by)
    tot = g.groupBy(*by).agg(F.sum("tp").alias("n_pos"), F.sum("fp").alias("n_neg"))
    if by:
        return cur.join(F.broadcast(tot), by)  # one row per class: bounded
    return _attach_scalars(cur, tot)


def _attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate (collected: it is a scalar row)."""
    row = one_row.first()
    types = {f.name: f.dataType for f in one_row.schema.fields}
    return df.select("*", *[F.lit(row[c]).cast(types[c]).alias(c) for c in one_row.columns])


# ── threshold metrics (M3–M5) ──────────────────────────────────────────────
def binary_threshold_metrics(df: DataFrame, threshold: float, by: list[str] | tuple = ()) -> DataFrame:
    """M3–M5, M9, M10 at one threshold, in one aggregate pass.

    Columns: n, accuracy, balanced_accuracy, precision, recall, f1,
    positive_rate, base_rate, brier_score, log_loss.
    """
    y, p = F.col("y"), F.col("p")
    yhat = (p >= F.lit(float(threshold))).cast("int")
    a = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(((yhat == 1) & (y == 1)).cast("long")).alias("tp"),
        F.sum(((yhat == 1) & (y == 0)).cast("long")).alias("fp"),
        F.sum(((yhat == 0) & (y == 0)).cast("long")).alias("tn"),
        F.sum(((yhat == 0) & (y == 1)).cast("long")).alias("fn"),
        F.avg(F.pow(p - y, 2)).alias("brier_score"),
        F.avg(-F.log(F.greatest(F.when(y == 1, p).otherwise(1 - p), F.lit(EPS)))).alias("log_loss"),
    )
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(tp, tp + fp), zero)
    recall = F.coalesce(F.try_divide(tp, tp + fn), zero)
    spec = F.coalesce(F.try_divide(tn, tn + fp), zero)
    present = (F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0))
    bal = F.coalesce(F.try_divide(F.when(tp + fn > 0, recall).otherwise(zero) + F.when(tn + fp > 0, spec).otherwise(zero), present), zero)
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero)
    return a.select(
        *by, "n",
        F.coalesce(F.try_divide(tp + tn, n), zero).alias("accuracy"),
        bal.alias("balanced_accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        F.coalesce(F.try_divide(tp + fp, n), zero).alias("positive_rate"),
        F.coalesce(F.try_divide(tp + fn, n), zero).alias("base_rate"),
        "brier_score", "log_loss",
    )


def confusion_binary(df: DataFrame, threshold: float) -> DataFrame:
    """M2 (binary): counts for (actual, predicted) ∈ {0,1}², zeros included."""
    yhat = (F.col("p") >= F.lit(float(threshold))).cast("int")
    counts = df.groupBy(F.col("y").cast("int").alias("actual"), yhat.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(1).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("actual")) \
        .select("actual", F.explode(F.array(F.lit(0), F.lit(1))).alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


# ── curve metrics (M6, M8, M11–M14) ────────────────────────────────────────
def auc_from_curve(curve: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """M6: ROC-AUC with ties half-counted — Σ fp·(ctp_before + tp/2) / (P·N)."""
    by = list(by)
    term = F.col("fp") * ((F.col("ctp") - F.col("tp")) + F.col("tp") / 2.0)
    return curve.groupBy(*by).agg(
        F.when((F.first("n_pos") > 0) & (F.first("n_neg") > 0), F.sum(term) / (F.first("n_pos").cast("double") * F.first("n_neg"))).alias("roc_auc"))


def average_precision_from_curve(curve: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """M8: step-wise AP — Σ (tp/P) · ctp/(ctp+cfp)."""
    term = F.col("tp") / F.col("n_pos") * (F.col("ctp") / (F.col("ctp") + F.col("cfp")))
    return curve.groupBy(*list(by)).agg(F.when(F.first("n_pos") > 0, F.sum(term)).alias("average_precision"))


def best_f1_threshold(curve: DataFrame) -> DataFrame:
    """Threshold maximising F1 over distinct scores; ties → lowest; one class → 0.5."""
    f1 = F.coalesce(F.try_divide(2 * F.col("ctp"), F.col("ctp") + F.col("cfp") + F.col("n_pos")), F.lit(0.0))
    best = curve.agg(
        F.max(F.struct(f1.alias("f1"), (-F.col("p")).alias("neg"))).alias("b"),
        F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    return best.select(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), -F.col("b.neg")).otherwise(F.lit(0.5)).alias("threshold"))


def best_youden_threshold(curve: DataFrame) -> DataFrame:
    """Threshold maximising TPR−FPR; ties → highest; "predict none" wins at J ≤ 0 → 0.5."""
    j = F.col("ctp") / F.col("n_pos") - F.col("cfp") / F.col("n_neg")
    best = curve.agg(F.max(F.struct(j.alias("j"), F.col("p").alias("t"))).alias("b"),
                     F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("b.j") > 0)
    return best.select(F.when(ok, F.col("b.t")).otherwise(F.lit(0.5)).alias("threshold"))


def _np5(x: Column) -> Column:
    """NumPy-style 5 dp rounding (half-even on the scaled binary value)."""
    return F.rint(x * F.lit(1e5)) / F.lit(1e5)


def _thin_index(n: Column, limit: int = CURVE_POINTS) -> Column:
    """Indices kept by linspace(0, n-1, limit).astype(int), as a column of arrays."""
    step = (n - 1).cast("double") / F.lit(float(limit - 1))
    idx = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.when(i == limit - 1, n - 1).otherwise((i.cast("double") * step).cast("long")))
    return F.when(n <= limit, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(idx)


def _ranked(curve: DataFrame, ascending: bool) -> DataFrame:
    """Attach the 0-based position of each distinct score (ranged running count)."""
    one = curve.withColumn("_one", F.lit(1).cast("long"))
    order = F.col("p") if not ascending else -F.col("p")
    keyed = one.withColumn("_o", order)
    r = running_totals(keyed, "_o", ["_one"])
    return r.withColumn("idx", F.col("c_one") - 1).drop("_one", "c_one", "_o")


def roc_points(curve: DataFrame) -> DataFrame:
    """ROC curve as (idx, fpr, tpr), 5 dp, intermediate collinear points
    dropped, (0,0) first, thinned to ≤ 200 points."""
    r = _ranked(curve, ascending=False)
    # neighbours by position: equi-joins on idx±1 (distributed, no global window)
    prev = r.select((F.col("idx") + 1).alias("idx"), F.col("tp").alias("tp_prev"), F.col("fp").alias("fp_prev"))
    nxt = r.select((F.col("idx") - 1).alias("idx"), F.col("tp").alias("tp_next"), F.col("fp").alias("fp_next"))
    n_total = r.agg(F.count(F.lit(1)).alias("n_pts"))
    x = r.join(prev, "idx", "left").join(nxt, "idx", "left")
    x = _attach_scalars(x, n_total)
    keep = (F.col("idx") == 0) | (F.col("idx") == F.col("n_pts") - 1) | \
        (F.col("fp_next") != F.col("fp")) | (F.col("tp_next") != F.col("tp"))
    kept = x.where(keep).select("p", "ctp", "cfp", "n_pos", "n_neg")
    zero = kept.limit(1).select(F.lit(2.0).alias("p"), F.lit(0).cast("long").alias("ctp"), F.lit(0).cast("long").alias("cfp"), "n_pos", "n_neg")
    pts = kept.unionByName(zero).withColumn("tp", F.lit(0)).withColumn("fp", F.lit(0))
    pts = _ranked(pts, ascending=False)
    m = pts.agg(F.count(F.lit(1)).alias("m"))
    pts = _attach_scalars(pts, m)
    chosen = pts.where(F.array_contains(_thin_index(F.col("m")), F.col("idx")))
    pos = F.array_position(_thin_index(F.col("m")), F.col("idx")) - 1
    return chosen.select(
        pos.cast("int").alias("point"),
        _np5(F.col("cfp") / F.col("n_neg")).alias("fpr"),
        _np5(F.col("ctp") / F.col("n_pos")).alias("tpr"),
    )


def pr_points(curve: DataFrame) -> DataFrame:
    """precision–recall curve in ascending-threshold order plus the final
    (precision 1, recall 0) point, thinned to ≤ 200 points, 5 dp."""
    r = _ranked(curve, ascending=True)
    n = r.agg(F.count(F.lit(1)).alias("n"))
    r = _attach_scalars(r, n)
    pts = r.select("idx", (F.col("ctp") / (F.col("ctp") + F.col("cfp"))).alias("precision"), (F.col("ctp") / F.col("n_pos")).alias("recall"), (F.col("n") + 1).alias("m"))
    last = pts.limit(1).select(F.col("m") - 1, F.lit(1.0), F.lit(0.0), F.col("m")).toDF("idx", "precision", "recall", "m")
    allp = pts.unionByName(last)
    chosen = allp.where(F.array_contains(_thin_index(F.col("m")), F.col("idx")))
    pos = F.array_position(_thin_index(F.col("m")), F.col("idx")) - 1
    return chosen.select(pos.cast("int").alias("point"), _np5(F.col("precision")).alias("precision"), _np5(F.col("recall")).alias("recall"))


# ── multiclass (M2, M3, M4, M7) ────────────────────────────────────────────
def argmax_label(probs: Column, labels: list[str]) -> Column:
    """SC3/M*: label of the largest probability (first on ties)."""
    arr = F.array(*[F.lit(l) for l in labels])
    return F.element_at(arr, F.array_position(probs, F.array_max(probs)).cast("int"))


def multiclass_metrics(df: DataFrame, labels: list[str], by: list[str] | tuple = ()) -> DataFrame:
    """M3/M4 multiclass: accuracy, balanced accuracy (classes in truth), and
    macro precision/recall/F1 over labels in truth ∪ prediction; one row (a group)."""
    scored = df.withColumn("yhat", argmax_label(F.col("probs"), labels))
    by = list(by)
    per_true = scored.groupBy(*by, F.col("y").alias("label")).agg(
        F.count(F.lit(1)).alias("support"), F.sum((F.col("yhat") == F.col("y")).cast("long")).alias("tp"))
    per_pred = scored.groupBy(*by, F.col("yhat").alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    per = per_true.join(per_pred, [*by, "label"], "full_outer").fillna(0, ["support", "tp", "predicted"])
    z = F.lit(0.0)
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), z)
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), z)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), z)
    return per.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, rec)).alias("balanced_accuracy"),
        F.avg(prec).alias("precision"),
        F.avg(rec).alias("recall"),
        F.avg(f1).alias("f1"),
    )


def confusion_multiclass(df: DataFrame, labels: list[str]) -> DataFrame:
    """M2 multiclass: k×k counts including zeros (grid from the label list, no join of data with itself)."""
    scored = df.select(F.col("y").alias("actual"), argmax_label(F.col("probs"), labels).alias("predicted"))
    counts = scored.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    arr = F.array(*[F.lit(l) for l in labels])
    grid = df.sparkSession.range(1).select(F.explode(arr).alias("actual")).select("actual", F.explode(arr).alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def ovr_auc(df: DataFrame, labels: list[str]) -> DataFrame:
    """M7: one-vs-rest macro ROC-AUC; NULL unless every class occurs in truth."""
    long = df.select("y", F.posexplode("probs").alias("ci", "p")).select(
        F.col("ci"), F.col("p"), (F.col("y") == F.element_at(F.array(*[F.lit(l) for l in labels]), F.col("ci") + 1)).cast("int").alias("y"))
    curve = score_curve(long, by=["ci"])
    per = auc_from_curve(curve, by=["ci"])
    present = df.agg(F.count_distinct("y").alias("k"))
    out = per.agg(F.avg("roc_auc").alias("roc_auc"), F.count(F.lit(1)).alias("m"))
    out = _attach_scalars(out, present)
    return out.select(F.when(F.col("k") == len(labels), F.col("roc_auc")).alias("roc_auc"))


def multiclass_log_loss(df: DataFrame, labels: list[str]) -> DataFrame:
    """M10 multiclass: mean −ln(max(p_true, eps))."""
    arr = F.array(*[F.lit(l) for l in labels])
    p_true = F.element_at(F.col("probs"), F.array_position(arr, F.col("y")).cast("int"))
    return df.agg(F.avg(-F.log(F.greatest(F.coalesce(p_true, F.lit(0.0)), F.lit(EPS)))).alias("log_loss"))


# ── M15, M16 ───────────────────────────────────────────────────────────────
def choose_threshold(df: DataFrame, strategy: str = "best_f1") -> float:
    """M13–M15 as a scalar: the cut-off to use at scoring time."""
    if strategy == "default":
        return 0.5
    curve = score_curve(df)
    t = (best_youden_threshold(curve) if strategy == "best_youden" else best_f1_threshold(curve)).first()
    return 0.5 if t is None or t["threshold"] is None else float(t["threshold"])


PRIMARY_ORDER = ("roc_auc", "average_precision", "f1", "balanced_accuracy", "accuracy")


def primary_score(report: DataFrame, metric: str) -> Column:
    """The chosen metric, falling back through the fixed order; NaN counts as missing."""
    order = [metric, *[m for m in PRIMARY_ORDER if m != metric]]
    vals = [F.when(~F.isnan(F.col(m)), F.col(m)) for m in order if m in report.columns]
    return F.coalesce(*vals, F.lit(0.0))


def binary_report(df: DataFrame, threshold: float) -> DataFrame:
    """One-row report: threshold metrics + ROC-AUC + AP (when both classes occur)."""
    base = binary_threshold_metrics(df, threshold)
    curve = score_curve(df).persist()
    auc = auc_from_curve(curve).first()["roc_auc"]
    ap = average_precision_from_curve(curve).first()["average_precision"]
    curve.unpersist()
    return base.select("*", F.lit(auc).cast("double").alias("roc_auc"), F.lit(ap).cast("double").alias("average_precision"))


def binary_report_by(df: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """`binary_report` for each group of ``by``: one row a group."""
    curve = score_curve(df, by)
    ranked = auc_from_curve(curve, by).join(average_precision_from_curve(curve, by), by)
    return binary_threshold_metrics(df, threshold, by).join(F.broadcast(ranked), by, "left")
