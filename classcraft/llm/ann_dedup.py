"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards.

Vectors are compared within a space: equal non-null label and equal length. Equal vectors of a space are one node with a
number of copies.

1. Shards: a space of more than `MAX_SHARD` nodes is split by k-means (centroids fit on at most `SAMPLE` nodes of a shard, every
   node assigned), each node going to its `OVERLAP` nearest clusters; shards still too large are split again. The centroids
   travel through the same shuffle as the nodes, ahead of them, in salted parts, so nothing is broadcast and a hot label spreads.
   What `MAX_DEPTH` splits leave too large (a clump of nearly equal vectors) is compared exactly, block by block.
2. Graph: in every shard, also where a space is one shard, a node's nearest and some spread-out candidates are pruned by the robust
   rule (a candidate goes if a kept neighbour is `ALPHA` times nearer to it than the node is); back edges are added. The adjacency
   lists of a node are united over its shards. The united graph is flat: a node is kept once, by one of its shards, its owner.
   A neighbour with another owner is a door to that owner, if it is near enough to lead to a link: by the pruning rule a
   node in range at distance r that is no neighbour is behind a neighbour nearer than r (1 + 1 / sqrt(ALPHA)); `DETOUR` times
   that is allowed, since nodes that share no shard were not compared and may be joined by a longer way only.
3. Search: every node is a query in its shards, greedily from the shard's medoids, and from its own place where it has one, with a
   beam of `BEAM`; then the range is expanded: neighbours of nodes in range are followed until none new is in range. Doors of
   what it found lead the query into further shards, in written rounds, until no query has a door left that it has not been through.
4. Links: what the searches find, verified: a link is a cosine in double precision of at least the threshold. As a node has one
   owner and a query comes there once, no pair counts twice. A link between nodes of one owner counts for both if either finds
   it. A shard hands on one count a node and a spanning forest, never pairs.
5. Audit: one node in `AUDIT_STEP`, but about `AUDIT` at least, chosen by hash, is compared with all nodes of its space in exact
   blocks. Recall is the share of their linked nodes that the index links them to (copies do not weigh), and by node the mean of
   that share over the nodes with a link, so that a dense clump does not hide lonely pairs. If either is under `MIN_RECALL` in some
   space, the index is built again with more overlap and a wider beam, `TRIES` builds in all; spaces that fail then are compared
   exactly, block by block. `audit_linked` is the number of audited nodes with a link; a warning says if it is under `ENOUGH`.

Edge cases: vectors that are null, zero or hold null or non-finite components, and those with a null label, link with
nothing; null ids count as links but never name a component unless it has no other; repeated rows are copies, linked to each
other; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classcraft.llm.common import written
from classcraft.llm.components import components
from classcraft.llm.simhash import forest

MAX_SHARD, TARGET, MAX_CLUSTERS, SAMPLE, MAX_DEPTH = 800, 400, 256, 8192, 4
DETOUR, BLOCK = 2, 3000
OVERLAP, DEGREE, CANDIDATES, SPREAD, ALPHA = 2, 24, 48, 8, 1.2
BEAM, MEDOIDS, QUERIES_AT_ONCE = 24, 12, 256
SALTS = 16
AUDIT, AUDIT_STEP, ENOUGH, MIN_RECALL, TRIES = 256, 50, 30, 0.9, 3
NODE = "shard string, node long, copies long, vector array<double>"


# ---------------------------------------------------------------- nodes

def nodes_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, shard, node, mark, vector) of every row; shard (the space), node, mark (128 bits of hash) and vector are null for rows that
    link with nothing."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    raw = vectors.select("vec_id", "label", v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    ok = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False))
    # scale by the largest component first, so that squares neither overflow nor vanish
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = raw.withColumn("ok", ok).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x / top + F.lit(0.0))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = scaled.withColumn("vector", F.transform("v", lambda x: x / norm))
    space = F.when(F.col("ok"), F.concat_ws("\x1f", F.col("label").cast("string"), F.size("vector").cast("string")))
    return unit.select("vec_id", space.alias("shard"), F.when(F.col("ok"), F.xxhash64("label", "vector")).alias("node"),
                       F.when(F.col("ok"), F.xxhash64(F.lit(1), "label", "vector")).alias("mark"), "vector")


# ---------------------------------------------------------------- 1. shards

def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by spherical k-means from evenly spaced rows."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(np.int64)]
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 0, sums / np.maximum(length, 1e-300), centers)
    return centers


def _fit_clusters(table: pa.Table) -> pa.Table:
    """Centroids of one shard from its sampled nodes (at most about SAMPLE)."""
    x, size = _matrix(table.column("vector")), table.column("size")[0].as_py()
    order = np.argsort(table.column("node").to_numpy())
    k = min(MAX_CLUSTERS, -(-size // TARGET), len(x))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()]), "centers": pa.array([kmeans(x[order], k).ravel().tolist()], pa.list_(pa.float64()))})


def _assign(overlap: int):
    """Rows sorted by (shard, kind): a shard's centroids, then its nodes, which go to their nearest clusters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, centers = None, None
        for batch in batches:
            shards, kinds = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = [i for i in range(len(shards)) if i == 0 or shards[i] != shards[i - 1]] + [len(shards)]
            for s, e in zip(edges, edges[1:]):
                if shards[s] != name:
                    name, centers = shards[s], None
                ahead = np.flatnonzero(kinds[s:e] == 0)  # each salted part of a shard brings the same centroids
                if len(ahead):
                    centers = np.array(batch.column(4)[s + int(ahead[0])].as_py())
                if len(ahead) == e - s:
                    continue
                part = batch.slice(s, e - s).filter(pa.array(kinds[s:e] == 1))
                x = _matrix(part.column(4))
                center = centers.reshape(-1, x.shape[1])
                take = min(overlap, len(center))
                near = np.sort(np.argsort(-(x @ center.T), axis=1, kind="stable")[:, :take], axis=1)
                row = np.repeat(np.arange(len(x)), take)
                names = [f"{name}\x1e{c}" for c in near.ravel().tolist()]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(names), part.column(2).take(rows), part.column(3).take(rows), part.column(4).take(rows)],
                                                 names=["shard", "node", "copies", "vector"])
    return run


def shards_of(nodes: DataFrame, overlap: int) -> DataFrame:
    """NODE rows with shards of at most MAX_SHARD nodes where splitting can reach that."""
    rows = nodes.select("shard", "node", "copies", "vector")
    for _ in range(MAX_DEPTH):
        sizes = written(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > MAX_SHARD), "ann-large")
        if sizes.isEmpty():
            break
        large = rows.join(sizes, "shard")
        share = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) < F.lit(float(SAMPLE << 20)) / F.col("size")
        centers = large.where(share).select("shard", "node", "vector", "size").groupBy("shard").applyInArrow(_fit_clusters, "shard string, centers array<double>")
        none = F.lit(None)
        ahead = centers.select("shard", F.lit(0).alias("kind"), none.cast("long").alias("node"), none.cast("long").alias("copies"),
                               F.col("centers").alias("vector"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        behind = large.select("shard", F.lit(1).alias("kind"), "node", "copies", "vector",
                              F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
        split = (ahead.unionByName(behind).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
                 .select("shard", "kind", "node", "copies", "vector").mapInArrow(_assign(overlap), NODE))
        rows = written(rows.join(sizes.select("shard"), "shard", "left_anti").unionByName(split), "ann-shards")
    return rows


# ---------------------------------------------------------------- 2. graph

def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of every row by robust pruning of its nearest and some spread-out candidates, with back edges."""
    m = len(x)
    if m == 1:
        return [np.empty(0, np.int64)]
    sims = (x @ x.T).astype(np.float32)
    np.fill_diagonal(sims, -2)
    near = min(CANDIDATES, m - 1)
    cand = np.argpartition(-sims, near - 1, axis=1)[:, :near]
    spread = (np.arange(m)[:, None] + np.linspace(1, m - 1, min(SPREAD, m - 1)).astype(np.int64)) % m
    cand = np.concatenate([cand, spread], axis=1)
    dist = 1 - np.take_along_axis(sims, cand, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
    alive = np.ones(cand.shape, bool)
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    source, target, rows = [], [], np.arange(m)
    for _ in range(DEGREE):
        has = alive.any(axis=1)
        if not has.any():
            break
        first = alive.argmax(axis=1)
        pick = cand[rows, first]
        source.append(rows[has])
        target.append(pick[has])
        between = 1 - sims[pick[:, None], cand]
        alive &= ~((ALPHA * between <= dist) & has[:, None])
        alive &= cand != pick[:, None]
    source, target = np.concatenate(source), np.concatenate(target)
    both = np.unique(np.concatenate([source * m + target, target * m + source]))
    starts = np.searchsorted(both, np.arange(m + 1) * m)
    return [both[s:e] % m for s, e in zip(starts[:-1], starts[1:])]


def cover_of(threshold: float) -> float:
    """The cosine down to which a neighbour may lead to a node in range (see 2. above; 1 - cosine goes with the squared distance)."""
    return 1 - (DETOUR * (1 + ALPHA ** -0.5)) ** 2 * (1 - threshold)


def _lists(rows: np.ndarray, values: np.ndarray, count: int) -> list[np.ndarray]:
    """The values of each row 0 .. count - 1; rows are sorted."""
    ends = np.searchsorted(rows, np.arange(count + 1))
    return [values[s:e] for s, e in zip(ends[:-1], ends[1:])]


def _adjacency(cover: float):
    """A shard's part of its nodes' lists: neighbours with the same owner, and the owners of other near ones."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x, ids, owner = _matrix(table.column("vector")), table.column("node").to_numpy(), table.column("owner").to_numpy()
        graph = pruned_graph(x)
        source, target = np.repeat(np.arange(len(ids)), [len(g) for g in graph]), np.concatenate(graph)
        same = owner[source] == owner[target]
        door = ~same & (np.einsum("ij,ij->i", x[source], x[target]) >= cover)
        inside, doors = _lists(source[same], ids[target[same]], len(ids)), _lists(source[door], owner[target[door]], len(ids))
        longs = pa.list_(pa.int64())
        return pa.table({"node": ids, "inside": pa.array(inside, longs), "doors": pa.array([np.unique(d) for d in doors], longs)})
    return run


# ---------------------------------------------------------------- 3. search

def medoids(x: np.ndarray, count: int) -> np.ndarray:
    """The row nearest the mean, then rows farthest from those chosen."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    closest = x @ x[chosen[0]]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, x @ x[chosen[-1]])
    return np.array(chosen)


def range_search(x: np.ndarray, starts: np.ndarray, flat: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs in range: greedy search from the medoids, then expansion from the rows in range.

    The graph's neighbours of row i are flat[starts[i]:starts[i + 1]].
    """
    return beam_search(x, x[queries], np.full(len(queries), -1), medoids(x, MEDOIDS), starts, flat, threshold, threshold, beam)[:2]


def beam_search(x: np.ndarray, at: np.ndarray, place: np.ndarray, entry: np.ndarray, starts: np.ndarray, flat: np.ndarray, threshold: float, cover: float,
                beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of what the vectors ``at`` find down to the similarity ``cover``; the range is expanded down to ``threshold``.

    A search starts from the rows ``entry`` and from its own row ``place``, unless that is -1.
    """
    q, m = len(at), len(x)
    seen = np.zeros((q, m), bool)
    seen[:, entry] = True
    ids = np.concatenate([np.tile(entry, (q, 1)), np.maximum(place, 0)[:, None]], axis=1)
    own = (place >= 0) & ~np.isin(place, entry)
    seen[np.flatnonzero(own), place[own]] = True
    sims = np.concatenate([at @ x[entry].T, np.where(own, np.einsum("ij,ij->i", at, x[np.maximum(place, 0)]), -2.0)[:, None]], axis=1)
    open_ = sims > -1.5

    def neighbours(rows, nodes):
        """(row, neighbour) not seen before by the row; marks them seen."""
        counts = starts[nodes + 1] - starts[nodes]
        row = np.repeat(rows, counts)
        at = np.repeat(starts[nodes] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        new = np.unique(row * m + flat[at])
        row, node = new // m, new % m
        fresh = ~seen[row, node]
        row, node = row[fresh], node[fresh]
        seen[row, node] = True
        return row, node

    found = []

    def keep(row, node, sim):
        hit = sim >= cover
        found.append((row[hit], node[hit], sim[hit]))

    keep(np.repeat(np.arange(q), ids.shape[1]), ids.ravel(), sims.ravel())
    while True:
        best = np.where(open_, sims, -3).argmax(axis=1)
        active = np.flatnonzero(open_[np.arange(q), best])
        if not len(active):
            break
        open_[active, best[active]] = False
        row, node = neighbours(active, ids[active, best[active]])
        if not len(row):
            continue
        sim = np.einsum("ij,ij->i", at[row], x[node])
        keep(row, node, sim)
        counts = np.bincount(row, minlength=q)
        width = counts.max()
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        more_ids, more_sims = np.zeros((q, width), np.int64), np.full((q, width), -2.0)
        more_ids[row, place], more_sims[row, place] = node, sim
        ids = np.concatenate([ids, more_ids], axis=1)
        sims = np.concatenate([sims, more_sims], axis=1)
        open_ = np.concatenate([open_, more_sims > -2], axis=1)
        if ids.shape[1] > beam:
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims, open_ = (np.take_along_axis(a, top, axis=1) for a in (ids, sims, open_))
    edge = tuple(np.concatenate(part) for part in zip(*found))
    edge = tuple(part[edge[2] >= threshold] for part in edge[:2])
    while len(edge[0]):  # expand the range
        row, node = neighbours(*edge)
        sim = np.einsum("ij,ij->i", at[row], x[node]) if len(row) else np.empty(0)
        keep(row, node, sim)
        hit = sim >= threshold
        edge = row[hit], node[hit]
    return tuple(np.concatenate(part) for part in zip(*found))


def _parts(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The queries and the nodes of a group, each by node."""
    kind = table.column("kind")
    return tuple(table.filter(pc.equal(kind, k)).sort_by("node") for k in (0, 1))


def _groups(members: DataFrame, queries: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the queries and the nodes of every shard (``code``), dealt to blocks of about BLOCK of either."""
    ceil = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("long")
    sizes = members.groupBy("code").agg(F.count(F.lit(1)).alias("m")).join(queries.groupBy("code").agg(F.count(F.lit(1)).alias("q")), "code").select(
        "code", ceil("m").alias("blocks"), ceil("q").alias("lots"))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    mine = members.join(sizes, "code").withColumn("kind", F.lit(1)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("lot", each("lots"))
    theirs = queries.join(sizes, "code").withColumn("kind", F.lit(0)).withColumn("lot", F.pmod(F.xxhash64("node", F.lit(3)), F.col("lots"))).withColumn("block", each("blocks"))
    return mine.unionByName(theirs, allowMissingColumns=True).drop("blocks", "lots").groupBy("code", "block", "lot").applyInArrow(run, schema)


# ---------------------------------------------------------------- 4. links

FOUND = "node long, links long, partners long, doors array<long>, a long, b long"


def _pairs(queries: np.ndarray, x: np.ndarray, y: np.ndarray, ids: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) rows of all pairs in range but of a node with itself, some queries at a time: every node is compared."""
    for s in range(0, len(queries), QUERIES_AT_ONCE):
        q, n = np.nonzero((y[s:s + QUERIES_AT_ONCE] @ x.T >= threshold - 1e-9) & (queries[s:s + QUERIES_AT_ONCE, None] != ids))
        q += s
        for t in range(0, len(q), 1 << 17):
            a, b = q[t:t + (1 << 17)], n[t:t + (1 << 17)]
            exact = np.einsum("ij,ij->i", y[a], x[b]) >= threshold
            yield a[exact], b[exact]


def _at(sorted_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The place of each id, or -1."""
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return np.where(sorted_ids[at] == ids, at, -1)


def _search(threshold: float, beam: int):
    """FOUND rows of a group: links and doors of its queries, by search, or by exact comparison where the shard is too large for a graph."""
    cover = cover_of(threshold)

    def run(table: pa.Table) -> pa.Table:
        queries, nodes = _parts(table)
        none, longs = (lambda n: pa.array([None] * n, pa.int64())), pa.list_(pa.int64())
        if not len(queries) or not len(nodes):  # a block that got no hash
            return pa.table({c: pa.array([], longs) if c == "doors" else none(0) for c in ("node", "links", "partners", "doors", "a", "b")})
        own, ids, copies = queries.column("node").to_numpy(), nodes.column("node").to_numpy(), nodes.column("copies").to_numpy()
        y, x, place = _matrix(queries.column("vector")), _matrix(nodes.column("vector")), _at(ids, own)
        doors = [row or [] for row in nodes.column("doors").to_pylist()]
        ways, leads = np.array([len(d) > 0 for d in doors]), [set(doors[p]) if p >= 0 else set() for p in place.tolist()]
        links, partners, a, b = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

        def count(q, n):
            nonlocal a, b
            np.add.at(links, q, copies[n])
            np.add.at(partners, q, 1)
            if len(q):
                a, b = forest(np.concatenate([a, own[q]]), np.concatenate([b, ids[n]]))

        def follow(q, n):
            through = ways[n]
            for row, node in zip(q[through].tolist(), n[through].tolist()):
                leads[row].update(doors[node])

        if nodes.column("exact")[0].as_py():
            for q, n in _pairs(own, x, y, ids, threshold):
                follow(q, n)
                count(q, n)
        else:
            near = [row or [] for row in nodes.column("inside").to_pylist()]
            flat, source = _at(ids, np.array([n for row in near for n in row], np.int64)), np.repeat(np.arange(len(ids)), [len(row) for row in near])
            starts, entry, pairs = np.searchsorted(source, np.arange(len(ids) + 1)), medoids(x, MEDOIDS), []
            for s in range(0, len(own), QUERIES_AT_ONCE):
                q, n, sim = beam_search(x, y[s:s + QUERIES_AT_ONCE], place[s:s + QUERIES_AT_ONCE], entry, starts, flat, threshold, cover, beam)
                q, other = q + s, own[q + s] != ids[n]
                follow(q[other], n[other])
                link = other & (sim >= threshold)
                pairs.append(q[link] * len(ids) + n[link])
            pairs = np.concatenate(pairs)
            q, n = pairs // len(ids), pairs % len(ids)
            back = _at(own, ids)[n]  # the link seen from its other end, if that is a query here too
            both = (place[q] >= 0) & (back >= 0)
            pairs = np.unique(np.concatenate([pairs, back[both] * len(ids) + place[q[both]]]))
            count(pairs // len(ids), pairs % len(ids))
        has = np.array([i for i in range(len(own)) if partners[i] or leads[i]], np.int64)
        return pa.concat_tables([
            pa.table({"node": pa.array(own[has]), "links": pa.array(links[has]), "partners": pa.array(partners[has]),
                      "doors": pa.array([sorted(leads[i]) for i in has.tolist()], longs), "a": none(len(has)), "b": none(len(has))}),
            pa.table({"node": none(len(a)), "links": none(len(a)), "partners": none(len(a)), "doors": pa.array([None] * len(a), longs),
                      "a": pa.array(a), "b": pa.array(b)})])
    return run


def _links(rows: DataFrame, threshold: float, beam: int) -> DataFrame:
    """FOUND rows of all links the index finds in ``rows`` (shard, node, copies, vector, whole); shards with ``whole`` get no graph."""
    rows = rows.withColumn("code", F.xxhash64("shard"))
    sizes = rows.groupBy("code").agg((F.bool_or("whole") | (F.count(F.lit(1)) > MAX_SHARD)).alias("exact"))
    rows = rows.select("code", "node", "copies", "vector").join(sizes, "code")
    owners = rows.groupBy("node").agg(F.min(F.struct(~F.col("exact"), F.col("code"))).getField("code").alias("owner"))
    members = written(rows.join(owners, "node"), "ann-members")
    graph = members.where("NOT exact").select("code", "node", "vector", "owner").groupBy("code").applyInArrow(
        _adjacency(cover_of(threshold)), "node long, inside array<long>, doors array<long>")
    united = graph.groupBy("node").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("inside", "doors")])
    placed = written(members.where("code = owner").select("code", "node", "copies", "vector", "exact").join(united, "node", "left"), "ann-graph")
    # what shares a shard that is compared exactly is compared wherever it is owned
    beside = members.where("exact AND code <> owner").select("code", F.col("owner").alias("other")).distinct()
    homes = members.select("node", "code")
    visited = written(homes.unionByName(members.select("node", "code").join(beside, "code").select("node", F.col("other").alias("code"))).distinct(), "ann-visits")
    ahead, found = visited, None
    while not ahead.isEmpty():
        queries = ahead.join(placed.select("node", "vector"), "node")
        got = written(_groups(placed, queries, _search(threshold, beam), FOUND), "ann-links")
        found = got if found is None else found.unionByName(got)
        ahead = written(got.where(F.size("doors") > 0).select("node", F.explode("doors").alias("code")).distinct().join(visited, ["node", "code"], "left_anti"), "ann-visits")
        visited = visited.unionByName(ahead)
    return found if found is not None else rows.sparkSession.createDataFrame([], FOUND)


# ---------------------------------------------------------------- 5. audit

def _true_partners(threshold: float):
    """How many nodes of a group each of its queries is linked to."""
    def run(table: pa.Table) -> pa.Table:
        queries, nodes = _parts(table)
        own = queries.column("node").to_numpy()
        true = np.zeros(len(own), np.int64)
        if len(own) and len(nodes):  # a block may have got no hash
            for q, _ in _pairs(own, _matrix(nodes.column("vector")), _matrix(queries.column("vector")), nodes.column("node").to_numpy(), threshold):
                true += np.bincount(q, minlength=len(own))
        return pa.table({"node": pa.array(own), "linked": pa.array(true)})
    return run


def truth_of(nodes: DataFrame, threshold: float) -> DataFrame:
    """(shard, node, linked) of the audited nodes with a link: how many nodes of the space they are linked to, by brute force."""
    share = max(1 / AUDIT_STEP, AUDIT / max(nodes.count(), 1))
    rows = nodes.select("shard", F.xxhash64("shard").alias("code"), "node", "vector")
    picked = rows.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))
    true = _groups(rows.drop("shard"), picked.drop("shard"), _true_partners(threshold), "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))
    return written(picked.select("shard", "node").join(true.where("linked > 0"), "node"), "ann-truth")


def audited(truth: DataFrame, counts: DataFrame) -> tuple[float, float, int, DataFrame]:
    """Recall by link and by node, number of audited nodes with a link, and the spaces (shard) that fall short."""
    share = F.col("found") / F.col("linked")
    rows = truth.join(counts, "node", "left").withColumn("found", F.coalesce("partners", F.lit(0)))
    by_link, by_node = F.sum("found") / F.sum("linked"), F.avg(share)
    short = rows.groupBy("shard").agg(by_link.alias("l"), by_node.alias("n")).where(F.least("l", "n") < MIN_RECALL).select("shard")
    row = rows.agg(by_link.alias("l"), by_node.alias("n"), F.count(F.lit(1)).alias("nodes")).first()
    return (row.l, row.n, row.nodes, written(short, "ann-short")) if row.nodes else (1.0, 1.0, 0, written(short, "ann-short"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall, audit_node_recall, audit_linked) of every row of (vec_id, embedding, label)."""
    rows = written(nodes_of(vectors), "ann-rows")
    nodes = rows.where("node IS NOT NULL").groupBy("shard", F.col("node").alias("hash"), "mark").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.first("vector").alias("vector"))
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("mark", "shard"))  # over 1 where different vectors share 64 bits
    nodes = written(nodes.withColumn("rank", rank).withColumn("node", F.when(F.col("rank") == 1, F.col("hash")).otherwise(F.xxhash64("mark", "hash", "rank"))).drop("rank"),
                    "ann-nodes")
    truth = truth_of(nodes, threshold)
    overlap, beam, exact = OVERLAP, BEAM, None
    for attempt in range(TRIES + 1):
        plain = nodes if exact is None else nodes.join(exact, "shard", "left_anti")
        shards = shards_of(plain, overlap).withColumn("whole", F.lit(False))
        if exact is not None:  # one shard a space, compared exactly
            shards = shards.unionByName(nodes.join(exact, "shard", "left_semi").select("shard", "node", "copies", "vector", F.lit(True).alias("whole")))
        edges = _links(shards, threshold, beam)
        counts = edges.where("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))
        recall, node_recall, linked, short = audited(truth, counts)
        if exact is not None or short.isEmpty():
            break
        if attempt == TRIES - 1:
            exact = short
        else:
            overlap, beam = overlap + 2, beam * 2
    if linked < ENOUGH:
        warnings.warn(f"the recall audit saw {linked} nodes with a link, too few to tell the recall", stacklevel=2)
    roots = components(edges.where("a IS NOT NULL").select("a", "b"))
    placed = nodes.select("node", "shard", "hash", "mark", "first", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = (placed.join(names, "root").join(counts, "node", "left")
             .select("shard", F.col("hash").alias("node"), "mark", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = rows.select("vec_id", "shard", "node", "mark").join(facts, ["shard", "node", "mark"], "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(float(recall)).alias("audit_recall"),
                      F.lit(float(node_recall)).alias("audit_node_recall"), F.lit(linked).cast("long").alias("audit_linked"))
