from __future__ import annotations

import hashlib

import numpy as np
import pytest

from classcraft.llm import induced, suffix_dedup
from classcraft.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(rows, length=100):
    """rows: (id, text) in order -> [(n_bytes, n_removed, n_spans, sha256 of the rest)]."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            if s in seen:
                gone[i:i + length] = True
            seen.add(s)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if raw else 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(docs, **options):
    left = suffix_dedup.remove_repeats(docs, **options).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in left}


@pytest.mark.parametrize("hot", [20_000, 1])
def test_whole_table_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    docs = table(spark, SF, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = run(docs.repartition(5))
    assert [got[i] for i, _ in rows] == brute(rows)


def test_small_slices_shards_and_memory(spark, monkeypatch):
    for name, value in (("SLICE", 700), ("ROWS_AT_ONCE", 50), ("SHARD_BYTES", 5000), ("MEMORY_ITEMS", 200)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé"), 5)) for _ in range(40)]
    passage = " ".join(rng.choice(words, 60))
    rows = []
    for i in range(40):
        parts = [" ".join(rng.choice(words, 80))]
        if i % 3 == 0:
            parts.append(passage)
        if i % 5 == 0:
            parts.append(passage[40:200])
        if i % 7 == 0 and rows:
            parts.append(rows[int(rng.integers(len(rows)))][1])
        parts.append(" ".join(rng.choice(words, 30)))
        rows.append((i, " ".join(parts)))
    rows += [(40, "ab" * 900), (41, "c" * 1500), (42, "ab" * 60 + "x"), (43, "c" * 100), (44, "c" * 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = run(docs)
    assert [got[i] for i, _ in rows] == brute(rows)


def test_edge_cases(spark):
    long = " ".join(str(i) for i in range(200))
    rows = [(1, None, "a"), (2, "", "b"), (3, long, "c"), (3, long, "c"), (4, "x" + long + "y", "d"), (None, long, "e"), (5, "short", "f"),
            (6, "é" * 120, "g"), (7, "zé" + "é" * 120, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = suffix_dedup.remove_repeats(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans))
    size = len(long)
    assert by[1] == by[2] == [(0, 0, 0)] and by[3] == [(size, 0, 0)] * 2
    assert by[4] == [(size + 2, size, 1)] and by[None] == [(size, size, 1)] and by[5] == [(5, 0, 0)]
    left = {(r.doc_id, r.kept): r.text for r in suffix_dedup.without_repeats(docs).collect()}
    assert left[(4, "d")] == "xy" and left[(3, "c")] == long and left[(1, "a")] is None
    assert suffix_dedup.without_repeats(docs).columns == docs.columns
    empty = docs.limit(0)
    assert suffix_dedup.remove_repeats(empty).count() == 0 and suffix_dedup.without_repeats(empty).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    long = " ".join(str(i) for i in range(200))
    docs = spark.createDataFrame([(1, long + "a"), (1, "b" + long)], "doc_id long, text string")
    got = sorted(r.n_removed for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [0, len(long)]


def test_induced_order_and_prefixes(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(300):
        monkeypatch.setattr(induced, "CHUNK", int(rng.choice([2, 5, 1 << 18])))
        raw = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 60))).astype(np.uint8)
        data, limit = raw.tobytes(), 20
        out = np.concatenate(list(induced.falling_suffixes(raw, limit, int(rng.choice([1, 4, 10, 1000])))))
        want = sorted(range(len(data)), key=lambda i: data[i:], reverse=True)
        assert out["pos"].tolist() == want

        def shared(i, j):
            k = 0
            while k < limit and max(i, j) + k < len(data) and data[i + k] == data[j + k]:
                k += 1
            return k

        assert out["lcp"].tolist() == [0] + [shared(a, b) for a, b in zip(want, want[1:])]
