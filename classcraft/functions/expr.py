"""Column-expression helpers shared by every operator.

All of these are built-in Spark expressions (whole-stage codegen, no Python
on the data path). ANSI mode is assumed on, so every parse and division uses
the ``try_`` variants.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal or scientific number, optionally signed (after trimming).
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Leading/trailing whitespace of any kind (Spark's trim strips spaces only).
EDGE_WHITESPACE = r"^\s+|\s+$"
OTHER = "Other"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Trim all leading/trailing whitespace (tabs and newlines included)."""
    return F.regexp_replace(col(c), EDGE_WHITESPACE, "")


def nan_to_null(c: str | Column) -> Column:
    """NaN and ±Infinity become NULL; nothing downstream handles NaN."""
    x = col(c)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def parse_number(c: str | Column) -> Column:
    """Text → double, NULL when the trimmed text is not a plain number."""
    s = strip_ws(col(c).cast("string"))
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def num(c: str | Column, dtype: str | None = None) -> Column:
    """Numeric view of a column; unparseable or missing → 0.0."""
    x = col(c)
    if dtype is not None and dtype not in ("string", "binary"):
        if dtype == "boolean":
            return F.coalesce(x.cast("double"), F.lit(0.0))
        return F.coalesce(nan_to_null(x.cast("double")), F.lit(0.0))
    return F.coalesce(parse_number(x), F.lit(0.0))


def fin(x: Column) -> Column:
    """NaN, ±Inf and NULL → 0.0 (degenerate maths never leaks out)."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b with 0.0 for a zero or missing denominator."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def coerce_numeric(c: str | Column) -> Column:
    """Trim, drop ``,`` and ``%``, blank → NULL, parse else NULL."""
    s = F.regexp_replace(strip_ws(col(c).cast("string")), "[,%]", "")
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def row_sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def row_product(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, cols)


def is_numeric_type(dtype: str) -> bool:
    return dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal")


def is_integer_type(dtype: str) -> bool:
    return dtype in ("tinyint", "smallint", "int", "bigint")


def np_round(c: str | Column, digits: int) -> Column:
    """Round half-to-even on the binary value scaled by 10^d, as NumPy's round does."""
    scale = float(10 ** digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)
