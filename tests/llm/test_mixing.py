from __future__ import annotations

import re

from classcraft.llm import mixing
from classcraft.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_targets(sizes):
    """sizes: source -> words. Reshare the excess by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def check(rows):
    sizes, taken, largest = {}, {}, {}
    for source, size, took in rows:
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + took
        largest[source] = max(largest.get(source, 0), size)
        assert took % size == 0 and took <= 2 * size if size else took == 0
    target = brute_targets(sizes)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    return target


def test_whole_table_meets_the_targets(spark):
    docs = table(spark, SF, "documents")
    by_id = {r.doc_id: r for r in docs.collect()}
    got = mixing.mix(docs).collect()
    assert len(got) == len(by_id)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", by_id[r.doc_id].text))
    target = check([(by_id[r.doc_id].source, r["size"], r.taken) for r in got])
    assert all(abs(r.target - target[by_id[r.doc_id].source]) < 1e-5 for r in got)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_edge_cases(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "w " * 5000, None), (None, "x y", "t"),
            (None, None, "u"), (5, " \n ", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "doc_id", "text", "source", "1 as size", "2 as target", "3 as h", "4 as _cut")
    got = mixing.mix(docs)
    assert got.count() == len(rows)
    check([(r.source, r["size"], r.taken) for r in got.collect()])
    assert mixing.mix(docs.limit(0)).count() == 0
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns and mixing.mixed_documents(docs.limit(0)).count() == 0
    times = {}
    for r in again.collect():
        times[(r.doc_id, r.text)] = times.get((r.doc_id, r.text), 0) + 1
    for r in got.collect():
        if r["size"] > 3 and r.doc_id == 4:
            assert times.get((4, "w " * 5000), 0) == r.n_copies


def test_all_empty(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0), (0, 0.0, 0)]
