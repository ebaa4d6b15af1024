from __future__ import annotations

import numpy as np
import pytest

from classcraft.llm import ann_dedup
from classcraft.llm.common import table

SF = "/root/testdata/sf0.01"


def brute(rows, threshold=0.98):
    """rows: (vec_id, label, vector) -> vec_id -> (links, smallest id reachable)."""
    fine = [i for i, (_, label, v) in enumerate(rows) if label is not None and v is not None and len(v) and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][2], float) / np.linalg.norm(np.array(rows[i][2], float)) for i in fine}
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, i in enumerate(fine):
        for j in fine[:p]:
            if rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return {r[0]: (links[i], least[find(i)]) for i, r in enumerate(rows)}


def collected(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("shard,depth,block", [(3000, 4, 3000), (40, 4, 3000), (40, 0, 3000), (40, 0, 40)])
def test_whole_table_with_planted_groups(spark, monkeypatch, shard, depth, block):
    for name, value in (("MAX_SHARD", shard), ("MAX_DEPTH", depth), ("BLOCK", block)):
        monkeypatch.setattr(ann_dedup, name, value)
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in table(spark, SF, "embeddings").collect()]
    rng = np.random.default_rng(4)
    for i in range(60):
        base = rows[int(rng.integers(len(rows)))]
        v = np.array(base[2]) * (1 if i % 4 else 3) + rng.normal(size=len(base[2])) * np.linalg.norm(base[2]) / 8 * rng.choice([0.0, 0.1, 0.15])
        rows.append((10_000 + i, base[1], v.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in df.collect()]
    want, out = brute(rows), ann_dedup.near_duplicates(df)
    got = collected(out)
    true = sum(n for n, _ in want.values())
    assert true > 60 and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.9 * true
    same = sum(got[i][1] == want[i][1] for i in want)
    assert same >= 0.99 * len(want)
    if depth == 0:  # blocks compare exactly
        assert got == want
    assert out.first().audit_recall >= 0.9


def test_graph_search_finds_a_dense_range():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(700, 16)), rng.normal(size=(1, 16)) * 5 + rng.normal(size=(150, 16)) * 0.1])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann_dedup.pruned_graph(x)
    starts = np.concatenate([[0], np.cumsum([len(g) for g in graph])])
    q, n = ann_dedup.range_search(x, starts, np.concatenate(graph), np.arange(len(x)), 0.98, ann_dedup.BEAM)
    true = x @ x.T >= 0.98
    assert true[q, n].all() and len(np.unique(q * len(x) + n)) >= 0.97 * true.sum()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (3, 1, [1.0, 0.0]), (4, 1, None), (5, 1, [0.0, 0.0]), (6, 1, [nan, 1.0]), (7, 1, [inf, 1.0]),
            (8, 1, [None, 1.0]), (9, None, [1.0, 0.0]), (10, 2, [1.0, 0.0]), (11, 1, [1.0, 0.0, 0.0]), (12, 1, []), (13, 1, [0.99, 0.1]),
            (14, 1, [0.9, 0.3]), (15, 3, [1e-30, 0.0]), (16, 3, [1e30, 1e28])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "'x' as node", "1 as shard")
    got = collected(ann_dedup.near_duplicates(df))
    assert got[1] == got[2] == got[3] == (3, 1) and got[13] == (3, 1)
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 14):
        assert got[i] == (0, i)
    assert got[15] == got[16] == (1, 15)
    assert ann_dedup.near_duplicates(df.limit(0)).count() == 0
    doubled = spark.createDataFrame([(1, 1, [1.0, 2.0])] * 3 + [(None, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<double>")
    out = ann_dedup.near_duplicates(doubled).collect()
    assert len(out) == 4 and all(r.n_links == 3 and r.component_id == 1 for r in out)


def test_salted_parts_of_a_shard_in_one_partition(spark, monkeypatch):
    monkeypatch.setattr(ann_dedup, "MAX_SHARD", 100)
    rng = np.random.default_rng(6)
    rows = [(i, 1, rng.normal(size=8).tolist()) for i in range(600)]
    rows += [(1000 + i, 1, (np.array(rows[i][2]) + 0.01).tolist()) for i in range(100)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
        want, got = brute(rows), collected(ann_dedup.near_duplicates(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values()) > 0


def test_pairs_across_shards(spark, monkeypatch):
    """Pairs whose nearest clusters do not meet are found over the united graph, and each counts once."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(900, 12))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=(400, 12))
    off -= (off * base[:400]).sum(axis=1, keepdims=True) * base[:400]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    x = np.concatenate([base, 0.901 * base[:400] + np.sqrt(1 - 0.901 ** 2) * off])
    top = np.argsort(-(x @ ann_dedup.kmeans(x, 87).T), axis=1)[:, :2].tolist()
    assert sum(not set(top[i]) & set(top[900 + i]) for i in range(400)) >= 10
    clusters = spark.createDataFrame([(i, c) for i, row in enumerate(top) for c in row], "first long, cluster long")
    monkeypatch.setattr(ann_dedup, "shards_of", lambda nodes, overlap: nodes.join(clusters, "first").selectExpr(
        "concat(shard, '\x1e', cluster) AS shard", "node", "copies", "vector"))
    monkeypatch.setattr(ann_dedup, "TRIES", 1)
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>").repartition(3)
    want, got = brute([(i, 1, v.tolist()) for i, v in enumerate(x)], 0.9), collected(ann_dedup.near_duplicates(df, 0.9))
    assert got == want


def test_spaces_that_fail_the_audit_are_compared_exactly(spark, monkeypatch):
    """An index that loses most lonely pairs, beside a clump and copies that it finds, does not pass."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 16))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.01, base[:1] + rng.normal(size=(30, 16)) * 0.01, np.repeat(base[-1:], 40, axis=0)])
    rows = [(i, 1, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(ann_dedup, "TRIES", 1)
    monkeypatch.setattr(ann_dedup, "shards_of", lambda nodes, overlap: nodes.selectExpr(
        "concat(shard, '\x1e', IF(first BETWEEN 180 AND 209, 'clump', CAST(pmod(node, 8) AS STRING))) AS shard", "node", "copies", "vector"))
    out = ann_dedup.near_duplicates(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute(rows)
    assert out[0].audit_recall == out[0].audit_node_recall == 1 and out[0].audit_linked >= 150
