from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from classcraft.llm import periodic
from classcraft.llm.common import table
from classcraft.llm.queries import op12_periodic

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    """Every lag tried at every start; a run counts at its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - first >= max(6, 4 * q) and not any(all(words[j] == words[j - p] for j in range(first + p, i)) for p in range(1, q)):
                found[(first, i - first, q)] = True
    return sorted(found, key=lambda r: (r[0], r[2]))


def diagonal_runs(words):
    """The plain dynamic programme: all earlier occurrences of each word increment their lags."""
    seen, active, found = {}, {}, []

    def ended(lag, m, end):
        if m + lag >= max(6, 4 * lag):
            found.append((end - m - lag + 1, m + lag, lag))

    for i, w in enumerate([*words, object()]):
        now = {i - j: active.get(i - j, 0) + 1 for j in seen.get(w, [])}
        for lag in active.keys() - now.keys():
            ended(lag, active[lag], i - 1)
        active = now
        seen.setdefault(w, []).append(i)
    smallest = [r for r in found if not any(s[2] < r[2] and s[0] <= r[0] and s[0] + s[1] >= r[0] + r[1] for s in found)]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def brute_words(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute_row(doc_id, text):
    words = brute_words(doc_id, text)
    runs = brute_runs(words) if len(words) < 600 else diagonal_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def numbers(words):
    names = {}
    return np.array([names.setdefault(w, len(names) + 1) for w in words])


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_words(letters):
    rng = np.random.default_rng(letters)
    for _ in range(400):
        parts = []
        for _ in range(rng.integers(1, 5)):
            block = rng.integers(0, letters, rng.integers(1, 9)).tolist()
            parts += block * int(rng.integers(1, 9)) + block[:int(rng.integers(0, len(block) + 1))]
        assert periodic.runs_of(numbers(parts)) == brute_runs(parts) == diagonal_runs(parts), parts


def test_fibonacci_and_thue_morse():
    a, b = "a", "ab"
    while len(b) < 900:
        a, b = b, b + a
    morse = [bin(i).count("1") % 2 for i in range(512)]
    cubes = [x for c in b[:60] for x in ([0, 1, 0] if c == "a" else [1]) * 4]
    for words in (list(b), morse, cubes, morse * 5):
        assert periodic.runs_of(numbers(words)) == diagonal_runs(words)


def test_periods_around_powers_of_two():
    rng = np.random.default_rng(7)
    for q in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65):
        for length in (4 * q - 1, 4 * q, 4 * q + 1, 9 * q):
            block = rng.permutation(1000)[:q].tolist()
            words = [2000, 2001] + (block * 9)[:length] + [2002, 2003]
            assert periodic.runs_of(numbers(words)) == ([(2, length, q)] if length >= max(6, 4 * q) else [])


def test_long_hot_text():
    assert periodic.runs_of(np.ones(300_000, np.int64)) == [(0, 300_000, 1)]
    two = np.tile([1, 2], 100_000)
    assert periodic.runs_of(np.concatenate([two, two + 5])) == [(0, 200_000, 2), (200_000, 200_000, 2)]


def test_texts_do_not_run_into_each_other(spark):
    rows = [(i, "x x x") for i in range(50)] + [(100 + i, "a b a b a b a b a") for i in range(3)]
    out = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert all(out[i].runs == [] and out[i].collapsed == "x x x" for i in range(50))
    assert all([tuple(r) for r in out[100 + i].runs] == [(0, 9, 2)] and out[100 + i].collapsed == "a b" for i in range(3))


def test_edge_cases(spark, monkeypatch):
    rows = [(1, None, 5), (2, "", 6), (None, "one one one one one one", 7), (3, " \t\n", 8), (4, "é é " * 7, 9), (4, "é é " * 7, 9), (5, "a b " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, body string, runs int")
    monkeypatch.setattr(periodic, "BATCH_BYTES", 20)
    out = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df, "body").collect()))
    assert out == [(0, 6, [(0, 6, 1)], "one"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 7, [(0, 7, 1)], "é é"), (4, 7, [(0, 7, 1)], "é é"),
                   (5, 100_000, [(0, 100_000, 2)], "a b")]
    assert periodic.periodic_runs(df.limit(0), "body").count() == 0


def test_query_against_brute_force(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in op12_periodic(spark, SF).collect()}
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in rows}
    assert got == want
    assert Counter(w[1] > 0 for w in want.values())[True] >= 10
