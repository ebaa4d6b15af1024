from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from classcraft.llm import whitening
from classcraft.llm.common import table
from classcraft.llm.queries import op13_whitening

SF = "/root/testdata/sf0.001"


def whole(vector):
    return [math.floor(64 * c) + 1_000_000 for c in vector]


def brute(rows, k):
    """(eigenvalues, vectors, centred fit list, n, S) by a dense decomposition of the exact centred rows."""
    fit_list = sorted({tuple(whole(v)) for v in rows})
    n = len(fit_list)
    sums = [sum(x[j] for x in fit_list) for j in range(len(fit_list[0]))]
    apart = [[n * c - s for c, s in zip(x, sums)] for x in fit_list]
    _, s, vt = np.linalg.svd(np.array([[float(Fraction(c, n)) for c in a] for a in apart]), full_matrices=False)
    return (s ** 2 / n)[:k], vt.T[:, :k], n, sums, float(Fraction(sum(c * c for a in apart for c in a), n ** 3))


def check(got, rows, k=16, alike=1e-7):
    values, vectors, n, sums, trace = brute([v for _, v in rows], k)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == {i for i, _ in rows}
    for i, v in rows:
        apart = [n * c - s for c, s in zip(whole(v), sums)]
        want = np.array(apart) / n @ vectors / np.sqrt(values)
        found = np.array([by_id[i][c + 1].whitened for c in range(len(values))])
        assert np.allclose(np.abs(found), np.abs(want), atol=alike)
        assert all(r.deviation == sum(a * a for a in apart) and r.n == n and r.identity_error <= 1e-4 for r in by_id[i].values())
        # the dense solver's own error is a part of the trace
        assert all(abs(by_id[i][c + 1].explained * trace - values[c]) < 1e-9 * values[c] + 1e-14 * trace for c in range(len(values)))
    return by_id


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    got = op13_whitening(spark, SF).collect()
    assert len(got) == 16 * len(rows)
    check(got, rows, alike=1e-6)


def test_badly_conditioned(spark):
    rng = np.random.default_rng(3)
    wide = rng.normal(size=(300, 6)) * np.array([40000.0, 300.0, 5.0, 1.0, 0.2, 0.05])
    turn, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    rows = [(i, v.tolist()) for i, v in enumerate(wide @ turn)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    check(whitening.whitened(df).collect(), rows)
    state, _ = whitening.fit(whitening.usable(df, "embedding", "vec_id"))
    assert 1 <= len(state.passes) <= 4 and state.passes[-1] < 1e-12 and state.identity_error < 1e-10


def test_same_sign_for_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 3)) * [9, 3, 1])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    values, vectors, n, sums, _ = brute([v for _, v in rows], 3)
    for c in range(3):
        found = {r.vec_id: r.whitened for r in got if r.component == c + 1}
        want = {i: float((np.array(whole(v)) - np.array(sums) / n) @ vectors[:, c] / np.sqrt(values[c])) for i, v in rows}
        assert len({np.sign(found[i] * want[i]) for i in want if abs(want[i]) > 1e-6}) == 1


def test_dimensions_without_spread_and_combinations(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(-50, 50, 60), rng.integers(-9, 9, 60)
    rows = [(i, [float(x), 3.0, float(y), float(x + y), float(x)]) for i, (x, y) in enumerate(zip(a, b))]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2}
    check(got, rows, k=2)


def test_edge_cases(spark):
    base = [(i, [float(i % 5), float(i % 3), float(i)]) for i in range(20)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 1.0, 1.0]), (105, [1.0, 2.0])]
    rows = base + [(7, base[7][1]), (7, base[7][1]), (500, base[3][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("x", F.lit(1))
    got = whitening.whitened(df).collect()
    assert len(got) == 3 * len(rows) and {r.vec_id for r in got} == {i for i, _ in rows}
    assert {r.n for r in got} == {20}
    check(got, sorted({i: (i, v) for i, v in rows}.values()))
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.where("vec_id = 7")).count() == 0          # one distinct vector
    assert whitening.whitened(df.withColumn("vec_id", F.lit(None).cast("long"))).where("vec_id IS NULL").count() == 3 * len(rows)


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(2 ** 22 * (i % 50)), float(i)]) for i in range(60)]
    df = spark.createDataFrame([(i, [v[0] * 4, v[1]]) for i, v in rows], "vec_id long, embedding array<double>")
    got = whitening.whitened(df).collect()
    exact = {}
    xs = {i: whole([v[0] * 4, v[1]]) for i, v in rows}
    n, sums = len(set(map(tuple, xs.values()))), [sum(x[j] for x in set(map(tuple, xs.values()))) for j in range(2)]
    for i, x in xs.items():
        e = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        exact[i] = e if e < 2 ** 63 else None
    assert {r.vec_id: r.deviation for r in got} == exact and None in exact.values()


@pytest.mark.parametrize("seed", range(3))
def test_shift_repairs(spark, seed):
    """Columns alike up to a few units: the first Gram matrix is singular to rounding without the shift."""
    rng = np.random.default_rng(seed)
    common = rng.normal(size=400) * 1e6
    rows = [(i, [float(c + rng.integers(-2, 3) / 64) for _ in range(4)]) for i, c in enumerate(common)]
    state, _ = whitening.fit(whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "embedding", "vec_id"))
    values, *_ = brute([v for _, v in rows], 4)
    assert len(state.explained) == 4 and state.identity_error < 1e-4
    assert np.allclose(np.array(state.explained) / state.explained[0], values / values[0], rtol=1e-3, atol=1e-16)
