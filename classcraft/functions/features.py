"""The closed vocabulary of 24 derived-feature operations.

Each operation is a pure column expression. The three stateful ones learn
their constants in one aggregate over the training rows (``fit_features``)
and are applied as literals afterwards (``apply_features``), so a later
batch — or a single row — is transformed exactly as the training data was.

Inputs pass through ``num`` (unparseable or missing → 0.0) and every result
through ``fin`` (NaN/±Inf → 0.0).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classcraft.functions.expr import fin, num, row_product, row_sum, safe_div, strip_ws

MISSING_PREFIX = "__missing__"

@dataclass(frozen=True)
class Operation:
    """What an operation takes: how many inputs, whether text will do, and which parameters.

    ``required`` must all be given, of ``one_of`` at least one; ``shapes`` says what a given parameter must look like, as
    (description, test of the value and the number of inputs).
    """

    least: int
    most: int | None
    text: bool = False
    fitted: bool = False
    required: tuple[str, ...] = ()
    one_of: tuple[str, ...] = ()
    shapes: dict[str, tuple[str, Any]] = field(default_factory=dict)


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


_WEIGHTS = ("a number for each input", lambda v, n: isinstance(v, list) and len(v) == n and all(map(_is_number, v)))
_MAPPING = ("a level-to-number table", lambda v, n: isinstance(v, dict))

# Fixed vocabulary: the operations, their input counts and their parameters.
OPERATIONS = {
    "sum": Operation(2, None), "mean": Operation(2, None), "product": Operation(2, None), "spread": Operation(2, None),
    "rowwise_max": Operation(2, None), "rowwise_min": Operation(2, None),
    "weighted_sum": Operation(2, None, required=("weights",), shapes={"weights": _WEIGHTS}),
    "difference": Operation(2, 2), "abs_difference": Operation(2, 2), "ratio": Operation(2, 2), "per_unit": Operation(2, 2),
    "count_above": Operation(1, None, required=("threshold",)),
    "scale": Operation(1, 1, required=("factor",)), "offset": Operation(1, 1, required=("offset",)),
    "clip": Operation(1, 1, one_of=("min", "max")), "log1p": Operation(1, 1), "sqrt": Operation(1, 1),
    "binarize_threshold": Operation(1, 1, required=("threshold",)),
    "binarize_equals": Operation(1, 1, text=True, required=("value",)),
    "category_map": Operation(1, 1, text=True, required=("mapping",), shapes={"mapping": _MAPPING}),
    "is_missing": Operation(1, 1, text=True),
    "normalize_max": Operation(1, 1, fitted=True), "min_max_scale": Operation(1, 1, fitted=True), "zscore": Operation(1, 1, fitted=True),
}
ARITY = {name: (op.least, op.most) for name, op in OPERATIONS.items()}
MAX_FEATURES = 40


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    op: str
    inputs: tuple[str, ...]
    params: dict[str, Any] = field(default_factory=dict, hash=False, compare=False)

    @staticmethod
    def of(name: str, op: str, inputs, **params) -> "FeatureSpec":
        return FeatureSpec(name, op, tuple(inputs), dict(params))


def missing_flag(column: str) -> str:
    return f"{MISSING_PREFIX}{column}"


def _nums(df_types: dict[str, str], inputs) -> list[Column]:
    return [num(c, df_types.get(c)) for c in inputs]


def feature_expr(spec: FeatureSpec, types: dict[str, str], state: dict[str, float] | None = None) -> Column:
    """The Spark expression computing one derived column."""
    op, p, state = spec.op, spec.params, state or {}
    xs = _nums(types, spec.inputs)
    if op == "sum":
        out = row_sum(xs)
    elif op == "mean":
        out = row_sum(xs) / F.lit(float(len(xs)))
    elif op == "weighted_sum":
        weights = [float(w) for w in p.get("weights", [])]
        if len(weights) != len(xs):
            raise ValueError(f"{spec.name}: one weight per input is required")
        out = row_sum([x * F.lit(w) for x, w in zip(xs, weights)])
    elif op == "product":
        out = row_product(xs)
    elif op == "difference":
        out = xs[0] - xs[1]
    elif op == "abs_difference":
        out = F.abs(xs[0] - xs[1])
    elif op == "ratio":
        return safe_div(xs[0], xs[1])
    elif op == "per_unit":
        return safe_div(xs[0], xs[1] + F.lit(1.0))
    elif op == "spread":
        out = F.greatest(*xs) - F.least(*xs) if len(xs) > 1 else F.lit(0.0)
    elif op == "rowwise_max":
        out = F.greatest(*xs) if len(xs) > 1 else xs[0]
    elif op == "rowwise_min":
        out = F.least(*xs) if len(xs) > 1 else xs[0]
    elif op == "count_above":
        t = F.lit(float(p.get("threshold", 0.0)))
        out = row_sum([(x >= t).cast("double") for x in xs])
    elif op == "scale":
        out = xs[0] * F.lit(float(p.get("factor", 1.0)))
    elif op == "offset":
        out = xs[0] + F.lit(float(p.get("offset", 0.0)))
    elif op == "clip":
        out = xs[0]
        if p.get("min") is not None:
            out = F.greatest(out, F.lit(float(p["min"])))
        if p.get("max") is not None:
            out = F.least(out, F.lit(float(p["max"])))
    elif op == "log1p":
        out = F.log1p(F.greatest(xs[0], F.lit(-0.999999)))
    elif op == "sqrt":
        out = F.sqrt(F.greatest(xs[0], F.lit(0.0)))
    elif op == "binarize_threshold":
        return (xs[0] >= F.lit(float(p.get("threshold", 0.0)))).cast("double")
    elif op == "binarize_equals":
        text = F.coalesce(F.col(spec.inputs[0]).cast("string"), F.lit(""))
        return (strip_ws(text) == F.lit(str(p.get("value")).strip())).cast("double")
    elif op == "category_map":
        mapping = {str(k): float(v) for k, v in (p.get("mapping") or {}).items()}
        default = F.lit(float(p.get("default", 0.0)))
        text = strip_ws(F.coalesce(F.col(spec.inputs[0]).cast("string"), F.lit("")))
        if not mapping:
            return fin(default)
        lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        out = F.coalesce(F.element_at(lookup, text), default)
    elif op == "is_missing":
        flag = missing_flag(spec.inputs[0])
        if flag in types:
            return num(flag, types[flag])
        return F.col(spec.inputs[0]).isNull().cast("double")
    elif op == "normalize_max":
        m = float(state.get("max", 0.0))
        return F.lit(0.0) if m == 0.0 else fin(xs[0] / F.lit(m))
    elif op == "min_max_scale":
        lo, hi = float(state.get("min", 0.0)), float(state.get("max", 0.0))
        return F.lit(0.0) if hi == lo else fin((xs[0] - F.lit(lo)) / F.lit(hi - lo))
    elif op == "zscore":
        sd = float(state.get("std", 0.0))
        return F.lit(0.0) if sd == 0.0 else fin((xs[0] - F.lit(float(state.get("mean", 0.0)))) / F.lit(sd))
    else:
        raise KeyError(f"unknown feature operation: {op}")
    return fin(out)


def _fit_aggs(spec: FeatureSpec, types: dict[str, str]) -> list[Column]:
    x = num(spec.inputs[0], types.get(spec.inputs[0]))
    n = spec.name
    if spec.op == "normalize_max":
        return [F.max(x).alias(f"{n}\u0001max")]
    if spec.op == "min_max_scale":
        return [F.min(x).alias(f"{n}\u0001min"), F.max(x).alias(f"{n}\u0001max")]
    if spec.op == "zscore":
        return [F.avg(x).alias(f"{n}\u0001mean"), F.stddev_samp(x).alias(f"{n}\u0001std")]
    return []


def fit_features(train: DataFrame, specs: list[FeatureSpec]) -> dict[str, dict[str, float]]:
    """Learn every stateful constant in ONE aggregate pass over the training rows."""
    types = dict(train.dtypes)
    aggs = [a for s in specs if OPERATIONS[s.op].fitted for a in _fit_aggs(s, types)]
    state: dict[str, dict[str, float]] = {s.name: {} for s in specs}
    if not aggs:
        return state
    row = train.agg(*aggs).first().asDict()
    for key, value in row.items():
        name, what = key.split("\u0001")
        v = 0.0 if value is None else float(value)
        if v != v or v in (float("inf"), float("-inf")):
            v = 0.0
        if what == "std" and v <= 0:
            v = 0.0
        state[name][what] = v
    return state


def apply_features(df: DataFrame, specs: list[FeatureSpec], state: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Append the derived columns in order, in a single projection."""
    types = dict(df.dtypes)
    state = state or {}
    exprs = [feature_expr(s, types, state.get(s.name)).alias(s.name) for s in specs]
    return df.select("*", *exprs)
