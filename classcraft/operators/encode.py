"""Encoding, splitting and weighting.

A row's place in a split or fold comes from the MD5 of its key (never ``rand()`` or ``monotonically_increasing_id``), so it is
the same on every re-evaluation and after any task retry. Quotas by class are exact: the cut-off of a class is an order
statistic of its hashes (`ranks`), so no class is sorted or gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classcraft.operators import ranks

SEED = 42
FEATURES = "__features"


# ── T1 ──────────────────────────────────────────────────────────────────────
def label_index(y: Column, labels: list[str]) -> Column:
    """Label text → 0-based index in the sorted label list (double, as MLlib wants)."""
    return (F.array_position(F.array(*[F.lit(v) for v in labels]), y.cast("string")) - 1).cast("double")


def index_label(idx: Column, labels: list[str]) -> Column:
    """T1 (inverse): 0-based index → label text."""
    return F.element_at(F.array(*[F.lit(v) for v in labels]), idx.cast("int") + 1)


# ── T2 ──────────────────────────────────────────────────────────────────────
def class_weights(counts: dict[str, int], strategy: str = "balanced", custom: dict[str, float] | None = None) -> dict[str, float]:
    """Per-class row weight. balanced = n / (k · count_c), also for an empty custom map; custom map (default 1.0); none = 1.0."""
    if strategy == "balanced" or strategy == "custom" and not custom:
        n, k = sum(counts.values()), len(counts)
        return {c: n / (k * m) for c, m in counts.items()}
    if strategy == "custom":
        return {c: float(custom.get(c, 1.0)) for c in counts}
    return {c: 1.0 for c in counts}


def weight_column(y: Column, weights: dict[str, float]) -> Column:
    """The weight of each row's class as a literal map lookup (no join)."""
    m = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.element_at(m, y.cast("string")), F.lit(1.0))


# ── T3, T4 ──────────────────────────────────────────────────────────────────
HASH_DIGITS = 13  # hex digits of the MD5: 52 bits, exact as a double


def hash_place(key: Column, seed: int) -> Column:
    """A fixed pseudo-random number of a key, 0 to 2^52."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double")


def _cuts(df: DataFrame, key: str, label: str, seed: int, wanted: dict[str, list[int]]) -> dict[str, list[float]]:
    long = df.select(F.col(f"`{label}`").cast("string").alias("g"), hash_place(F.col(f"`{key}`"), seed).alias("v"))
    values = ranks.order_statistics(long, wanted)
    return {g: [values[g][r] for r in sorted(set(rs)) if r in values[g]] for g, rs in wanted.items()}


def _by_label(label: Column, cuts: dict[str, list[float]], value) -> Column:
    out = F.lit(None)
    for g, at in cuts.items():
        out = F.when(label.cast("string") == g, value(at)).otherwise(out)
    return out


def clamped_share(share: float) -> float:
    return min(max(float(share), 0.1), 0.4)


def split_column(df: DataFrame, key: str, label: str, counts: dict[str, int], test_share: float = 0.2, seed: int = SEED) -> Column:
    """T3: 'test' for exactly the rounded share of every class (one row at least, all but one at most), else 'train'.

    ``counts``: rows of ``df`` by class. Share clamped to 0.1–0.4.
    """
    share = clamped_share(test_share)
    quota = {c: max(1, min(n - 1, int(share * n + 0.5))) for c, n in counts.items() if n > 1}
    cuts = _cuts(df, key, label, seed, {c: [q - 1] for c, q in quota.items()})
    place = hash_place(F.col(f"`{key}`"), seed)
    in_test = _by_label(F.col(f"`{label}`"), cuts, lambda at: place <= F.lit(at[0]))
    return F.when(F.coalesce(in_test, F.lit(False)), F.lit("test")).otherwise(F.lit("train"))


def fold_count(requested: int, smallest_class: int) -> int:
    return max(2, min(int(requested), int(smallest_class), 10))


def fold_column(df: DataFrame, key: str, label: str, counts: dict[str, int], k: int, seed: int = SEED) -> Column:
    """T4: fold 0..k-1; each class is dealt to the folds as evenly as its rows allow, in the order of a second hash."""
    wanted = {c: [-(-f * n // k) for f in range(1, k)] for c, n in counts.items()}
    cuts = _cuts(df, key, label, seed + 1, wanted)
    place = hash_place(F.col(f"`{key}`"), seed + 1)
    deal = lambda at: sum(((place >= F.lit(v)).cast("int") for v in at), F.lit(0))
    repeated = {c: [v for r in wanted[c] if r < counts[c] for v in [cuts[c][sorted(set(wanted[c])).index(r)]]] for c in wanted}
    return F.coalesce(_by_label(F.col(f"`{label}`"), repeated, deal), F.lit(0)).cast("int")


# ── E2 ──────────────────────────────────────────────────────────────────────
@dataclass
class ScalerState:
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)


def fit_scaler(train: DataFrame, columns: list[str]) -> ScalerState:
    """E2 fit: mean and population std of every column in one aggregate."""
    if not columns:
        return ScalerState()
    aggs = [x for c in columns for x in (F.avg(c).alias(f"m\u0001{c}"), F.stddev_pop(c).alias(f"s\u0001{c}"))]
    row = train.agg(*aggs).first().asDict()
    st = ScalerState()
    for c in columns:
        st.mean[c] = float(row[f"m\u0001{c}"] or 0.0)
        s = row[f"s\u0001{c}"]
        st.std[c] = float(s) if s is not None and s > 0 else 0.0
    return st


def scale_exprs(state: ScalerState, columns: list[str]) -> list[Column]:
    """E2 apply: (x − mean) / std, constant columns → 0.0."""
    out = []
    for c in columns:
        sd = state.std.get(c, 0.0)
        e = F.lit(0.0) if sd == 0.0 else (F.col(c) - F.lit(state.mean.get(c, 0.0))) / F.lit(sd)
        out.append(e.alias(c))
    return out


# ── E1, E3, E4 ──────────────────────────────────────────────────────────────
def fit_backstop(train: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, float | str]:
    """E1 fit: the median of each numeric and the mode of each categorical column."""
    fills: dict[str, float | str] = {c: 0.0 if v is None else v for c, v in
                                     ranks.medians(train, {c: F.col(f"`{c}`").cast("double") for c in numeric}).items()}
    return fills | {c: v or "" for c, v in ranks.modes(train, {c: (F.col(f"`{c}`"), False) for c in categorical}).items()}


def backstop_exprs(fills: dict[str, float | str], columns: list[str]) -> list[Column]:
    """E1 apply: what is still null, NaN or infinite gets its column's fill."""
    out = []
    for c in columns:
        x = F.col(f"`{c}`")
        if isinstance(fills.get(c), float):
            x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        out.append(F.coalesce(x, F.lit(fills[c])).alias(c) if c in fills else x)
    return out


def preprocessor(numeric: list[str], categorical: list[str], output: str = FEATURES) -> Pipeline:
    """E3 + E4: one-hot (unknown → all zeros) and assembly.

    ``StringIndexer(handleInvalid='keep')`` sends unseen/NULL levels to the
    extra last index and ``OneHotEncoder(dropLast=True)`` drops exactly that
    slot, so an unknown level encodes as all zeros while every known level
    keeps its own column.
    """
    stages = []
    idx = [f"__idx_{c}" for c in categorical]
    ohe = [f"__ohe_{c}" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep",
                                    stringOrderType="frequencyDesc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=[*numeric, *ohe], outputCol=output, handleInvalid="keep"))
    return Pipeline(stages=stages)


def encoded_feature_names(stages, numeric: list[str], categorical: list[str]) -> list[str]:
    """A readable name for every slot of the assembled vector."""
    names = list(numeric)
    for stage in stages:
        if hasattr(stage, "labelsArray"):
            names += [f"{c}_{level}" for c, levels in zip(categorical, stage.labelsArray) for level in levels]
    return names


# ── T6, T7 ──────────────────────────────────────────────────────────────────
def align_probs(probs: Column, member_labels: list[str], labels: list[str]) -> Column:
    """Reorder a member's probabilities to ``labels``; a class it lacks gets 0."""
    m = F.map_from_arrays(F.array(*[F.lit(v) for v in member_labels]), probs)
    return F.array(*[F.coalesce(F.element_at(m, F.lit(v)), F.lit(0.0)) for v in labels])


def soft_vote(members: list[Column], weights: list[float]) -> Column:
    """Weighted mean of aligned probability arrays; all-zero weights → plain mean."""
    total = float(sum(weights))
    ws = [w / total for w in weights] if total > 0 else [1.0 / len(members)] * len(members)
    def add(weight: float):
        return lambda a, b: a + b * F.lit(weight)

    out = F.transform(members[0], lambda x: x * F.lit(ws[0]))
    for m, w in zip(members[1:], ws[1:]):
        out = F.zip_with(out, m, add(w))
    return out
