"""Whitening of embeddings by shifted CholeskyQR: Gram passes and triangular solves over the distributed rows, no eigensolver on data.

Entries become whole numbers x = floor(64 c) + 1,000,000, so that sums are exact. The fit list holds every distinct x vector once (n of
them, sums S per dimension). Its centred rows A = x - S / n are orthogonalised without ever being changed on disk: a pass forms the
Gram matrix of A R^-1 (triangular solves per batch of rows, one d x d matrix from each task, summed by Spark), its Cholesky
factor is put before R, and so on. The first Gram matrix is shifted by a multiple of rounding error times its trace, so
that its factor exists however badly conditioned the rows are; the later passes repair the loss, until the Gram matrix is the identity
up to ``SETTLED``. Then A = Q R with orthonormal Q, and the singular values s and right vectors of the small R give the
covariance's eigenvalues s^2 / n and its unit eigenvectors, without the loss of squaring A's condition.

Dimensions without spread of their own (constant, or a combination of others) leave directions of no length in A. Once the Gram
matrix has no more than rounding error there, the rows are turned by its eigenvectors and these directions are left out: the
principal components are found among the rest, and a direction without variance is no component, since nothing
can be divided by its zero deviation.

On the driver there are only d x d matrices; tasks hold a batch of rows and one such matrix. The fit list is a written table, so a lost
executor costs only the repetition of its tasks. All products are of centred doubles; deviations are whole numbers.

Edge cases: a vector that is null, empty or holds null or non-finite entries is dropped; so is one whose length is not that of most
vectors (ties: the longer); repeated rows count once in the fit list and get a result each; null ids stay; a single
distinct vector or an empty table has no component and an empty result; fewer than ``k`` components of positive variance give
fewer rows; equal eigenvalues come in the order of the solver, any basis of theirs is right; a deviation beyond a
long is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classcraft.llm.common import written

SCALE, SHIFT = 64, 1_000_000
PASSES = 10              # Gram passes at most; three or four are the rule
SETTLED = 1e-13          # largest entry of Gram matrix minus identity, by dimensions
SUMMED = 1_000_000       # rows whose rounding the shift allows for; partial sums keep that of more rows below it
NO_LENGTH = 1e-9         # share of the shift below which a direction has no length
EPS = float(np.finfo(np.float64).eps)


def whole(vector: str) -> Column:
    """The vector's entries as whole numbers; null for a vector that is null or holds null or non-finite entries."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT).cast("long"))
    return F.when(good & (F.size(vector) > 0), x)


def usable(vectors: DataFrame, vector: str, id_column: str) -> DataFrame:
    """(id, x) of the vectors with good entries and the most frequent length."""
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), whole(f"`{vector}`").alias("x")).where("x IS NOT NULL")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (length.d if length else 0))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Whitening:
    """Fitted state: n, sums and, for each component, the whitening direction and its eigenvalue's share."""
    n: int
    sums: list[int]
    directions: np.ndarray       # d x k: unit eigenvector / sqrt(eigenvalue)
    explained: list[float]
    passes: list[float]          # distance of each Gram matrix from the identity
    identity_error: float | None

    def apart(self, x: np.ndarray) -> np.ndarray:
        return centred_numerator(x, self.n, self.sums)


def centred_numerator(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, whole; in Python integers where a long is too small."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max((abs(s) for s in sums), default=0))
    if largest < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def orthogonalised(rows: np.ndarray, factors: list[tuple[np.ndarray | None, np.ndarray]]) -> np.ndarray:
    """Rows through the factors so far: turned onto the directions that have length, then a triangular solve."""
    for keep, r in factors:
        rows = np.linalg.solve(r.T, (rows if keep is None else rows @ keep).T).T
    return rows


def gram(fit_list: DataFrame, n: int, sums: list[int], wide: int, change: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and column sums of the centred rows after ``change``, ``wide`` columns: one partial matrix from each task."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((wide, wide)), np.zeros(wide)
        for batch in batches:
            if batch.num_rows:
                rows = change(centred_numerator(_matrix(batch), n, sums).astype(np.float64) / n)
                total += rows.T @ rows
                first += rows.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(wide + 1), pa.int32()), pa.array([*total.tolist(), first.tolist()], pa.list_(pa.float64()))],
                                         names=["i", "v"])

    parts = fit_list.mapInArrow(partial, "i int, v array<double>")
    cells = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((wide + 1, wide))
    for r in cells.collect():
        out[r.i, r.j] = r.v
    return (out[:wide] + out[:wide].T) / 2, out[wide]


def sums_of(fit_list: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, []
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                large = int(np.abs(x).max()) * len(x) >= 1 << 62
                n, sums = n + len(x), [a + int(b) for a, b in zip(sums or [0] * x.shape[1], (x.astype(object) if large else x).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array(map(str, sums), pa.string())],
                                         names=["j", "n", "s"])

    parts = fit_list.mapInArrow(partial, "j int, n long, s string").groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sorted((r.j, r.n, int(r.s)) for r in parts.collect())
    return (found[0][1] if found else 0), [s for _, _, s in found]


def cholesky_qr(fit_list: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, list[float]]:
    """R of the centred rows A = Q R (as many rows as A has directions with length) and how far each Gram matrix was from the identity."""
    size = len(sums)
    factors: list[tuple[np.ndarray | None, np.ndarray]] = []
    r_whole, passes = np.eye(size), []
    for _ in range(PASSES):
        g, _ = gram(fit_list, n, sums, size, lambda rows: orthogonalised(rows, factors))
        keep = None
        if not factors:
            norm = float(np.linalg.norm(g, 2))
            if norm == 0.0:
                return np.zeros((0, size)), passes
            g = g + 11 * (size * min(n, SUMMED) + size * (size + 1)) * (EPS / 2) * norm * np.eye(size)
        else:
            passes.append(float(np.abs(g - np.eye(size)).max()))
            if passes[-1] <= SETTLED * size:
                return r_whole, passes
            # a direction of length s in A has s^2 / (s^2 + shift) after the shifted pass: rounding only, if it has none
            lengths, vectors = np.linalg.eigh(g)
            if lengths[0] < NO_LENGTH:
                keep = vectors[:, lengths >= NO_LENGTH]
                g, size = keep.T @ g @ keep, keep.shape[1]
                r_whole = keep.T @ r_whole
        r = np.linalg.cholesky(g).T
        factors = [*factors, (keep, r)]
        r_whole = r @ r_whole
    raise ArithmeticError("CholeskyQR did not settle")


def fit(x_rows: DataFrame, k: int = 16) -> tuple[Whitening | None, DataFrame]:
    """(the fitted whitening or None, the fit list) of a frame with the whole-number vectors ``x``."""
    fit_list = written(x_rows.select("x").distinct(), "whitening-fit")
    n, sums = sums_of(fit_list)
    r, passes = cholesky_qr(fit_list, n, sums) if n else (np.zeros((0, 0)), [])
    if not len(r):
        return None, fit_list
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    count = min(k, int((s > s[0] * len(sums) * EPS).sum()))
    values = s ** 2 / n
    directions = vt[:count].T / np.sqrt(values[:count])
    _, first = gram(fit_list, n, sums, count, lambda rows: rows @ directions)
    covariance, _ = gram(fit_list, n, sums, count, lambda rows: rows @ directions - first / n)
    error = float(np.abs(covariance / n - np.eye(count)).max())
    return Whitening(n, sums, directions, (values[:count] / values.sum()).tolist(), passes, error), fit_list


def apply(rows: DataFrame, state: Whitening) -> DataFrame:
    """(id, deviation, w): sum of (n x - S)^2 and the whitened components of every row's ``x``."""
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = state.apart(_matrix(batch))
            wide = float((apart.astype(np.float64) ** 2).sum(axis=1).max())
            if wide < 2.0 ** 62:
                deviation = (apart * apart).sum(axis=1).tolist()
            else:
                exact = [sum(int(a) ** 2 for a in row) for row in apart]
                deviation = [e if e < 1 << 63 else None for e in exact]
            w = apart.astype(np.float64) / state.n @ state.directions
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.array(w.tolist(), pa.list_(pa.float64()))],
                                             names=["id", "deviation", "w"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "x").mapInArrow(project, f"id {kind}, deviation long, w array<double>")


def whitened(vectors: DataFrame, vector: str = "embedding", id_column: str = "vec_id", k: int = 16) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(vectors, vector, id_column)
    state, _ = fit(rows, k)
    if state is None:
        state = Whitening(0, [], np.zeros((0, 0)), [], [], None)
        projected = rows.limit(0).select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("w"))
    else:
        projected = apply(rows, state)
    share = F.array(*[F.lit(float(e)) for e in state.explained]).cast("array<double>")
    error = F.lit(state.identity_error).cast("double")
    return projected.select("id", "deviation", F.posexplode("w").alias("c", "whitened")).select(
        F.col("id").alias(id_column), (F.col("c") + 1).cast("int").alias("component"), F.lit(state.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("c")).alias("explained"), error.alias("identity_error"))
