from __future__ import annotations

import numpy as np
import xxhash

from classcraft.llm import simhash
from classcraft.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if w]
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows):
    """rows: (id, fp) -> id -> smallest id reachable."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= 2:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i, _ in rows}


def as_rows(df):
    return [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id, r.kept) for r in df.collect()]


def test_whole_table_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    got = as_rows(simhash.near_duplicates(docs))
    want_fp = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {i: fp for i, fp, _, _ in got} == want_fp
    assert {i: c for i, _, c, _ in got} == brute_components(sorted(want_fp.items()))
    assert all(kept == (i == c) for i, _, c, kept in got)


def test_covering_meets_every_pair_in_reach():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    y = x.copy()
    for _ in range(2):
        y ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    home = simhash.homes(x)
    rows, cells, is_home = simhash.anchors(y, 2)
    reached = {(r, c) for r, c in zip(rows.tolist(), cells.tolist())}
    assert all((i, h) in reached for i, h in enumerate(home.tolist()))
    assert is_home.sum() == len(y) and len(rows) / len(y) < 100


def test_crowded_anchor_is_dealt_again_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_HOMES", 3)
    base = 0x123456789ABCDEF0
    fps = sorted({base ^ (1 << i) for i in range(64)} | {base, base ^ 7, base ^ (15 << 50)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(df).collect()]
    nodes = {int(np.uint64(f).view(np.int64)) for f in fps}
    group = {n: n for n in nodes}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        group[find(a)] = find(b)
    got = {}
    for n in nodes:
        got.setdefault(find(n), set()).add(n & (1 << 64) - 1)
    want = {}
    for i, c in brute_components([(f, f) for f in fps]).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_edge_cases(spark):
    rows = [(5, None, "a"), (6, "", "b"), (7, "  \n ", None), (8, "One two three four", "c"), (8, "One two three four", "c"),
            (9, "one TWO three four", "d"), (None, "one two three four", "e"), (None, "alone here", "f"), (10, "x" * 200_000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumnRenamed("fp", "component_id")
    got = sorted(as_rows(simhash.near_duplicates(docs)), key=repr)
    by_id = {i: (fp, c) for i, fp, c, _ in got if i is not None}
    assert by_id[5] == by_id[6] == by_id[7] == (0, 5)
    assert by_id[8][1] == by_id[9][1] == 8 and by_id[10][1] == 10
    assert len(got) == len(rows)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 5, 8, 10]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0
