"""SimHash near-duplicates by anchor-point covering.

The anchors are pairs of codewords of the perfect binary Golay code on bits 0-22 and 23-45 of the
fingerprint: every 23-bit word lies within 3 bits of exactly one codeword, so every fingerprint has one home
anchor. If two fingerprints differ in t bits, split as t1 + t2 over the two blocks, the home of one lies within
3 + t1 and 3 + t2 bits of the other. Each fingerprint is therefore copied to every anchor within those radii for
t1 + t2 up to the threshold (about 61 of the 2^24 anchors for two bits), and an anchor compares its homes to all
that came, by exact bit distance. No pair within the threshold is missed.

Exact copies are merged before (one row per distinct fingerprint), so a group of copies costs one row. An
anchor with more than `HOT_HOMES` homes is dealt again by a third Golay block on bits 41-63. An
anchor hands on a spanning forest of the links it found, not the pairs; the forests meet in `components`.

Edge cases: a null or wordless text has fingerprint zero, linked like any other; null ids come last in a
component, whose id is null only if all its ids are; repeated rows get the same result; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classcraft.llm.common import written
from classcraft.llm.components import components

# Generator polynomial of the binary Golay code of length 23, dimension 12, covering radius 3.
GOLAY_POLY, CODE_BITS, CHECK_BITS, RADIUS = 0b101011100011, 23, 11, 3
BLOCKS = (0, 23)
THIRD_BLOCK = 41
HOT_HOMES = 4096
PAIRS_AT_ONCE = 1 << 19
DEALT_AT_ONCE = 1024


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles; bit set if set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    spans = zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in spans], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint of every row as a signed long, and a hash of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "text_key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, text_key long, fp long")


# ---------------------------------------------------------------- the covering code

def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY_POLY << (bit - CHECK_BITS), 0)
    return rest


@lru_cache(maxsize=4)
def _cosets(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: start, and the error patterns of weight up to ``reach`` with their excess over the radius."""
    patterns = np.array([sum(1 << b for b in bits) for weight in range(reach + 1) for bits in combinations(range(CODE_BITS), weight)], np.int64)
    syndromes = _syndrome(patterns)
    excess = np.maximum(np.bitwise_count(patterns).astype(np.int64) - RADIUS, 0)
    order = np.lexsort((patterns, excess, syndromes))
    starts = np.searchsorted(syndromes[order], np.arange((1 << CHECK_BITS) + 1))
    return starts, patterns[order], excess[order]


def _block(fps: np.ndarray, shift: int) -> np.ndarray:
    return ((fps >> np.uint64(shift)) & np.uint64((1 << CODE_BITS) - 1)).astype(np.int64)


def _near(words: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codewords within RADIUS + distance of each word: (row, the codeword's 12 message bits, excess)."""
    starts, patterns, excess = _cosets(RADIUS + distance)
    syndromes = _syndrome(words)
    counts = starts[syndromes + 1] - starts[syndromes]
    rows = np.repeat(np.arange(len(words)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[syndromes[rows]] + within
    return rows, (words[rows] ^ patterns[at]) >> CHECK_BITS, excess[at]


def homes(fps: np.ndarray) -> np.ndarray:
    """The 24-bit home anchor of each fingerprint."""
    out = np.zeros(len(fps), np.int64)
    for shift in BLOCKS:
        out = out << 12 | _near(_block(fps, shift), 0)[1]
    return out


def anchors(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor within the covering radius plus ``distance``."""
    row1, code1, over1 = _near(_block(fps, BLOCKS[0]), distance)
    row2, code2, over2 = _near(_block(fps, BLOCKS[1]), distance)
    first = np.searchsorted(row2, row1)
    counts = np.searchsorted(row2, row1, side="right") - first
    left = np.repeat(np.arange(len(row1)), counts)
    right = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    total = over1[left] + over2[right]
    keep = total <= distance
    left, right = left[keep], right[keep]
    return row1[left], code1[left] << 12 | code2[right], total[keep] == 0


def _refined(rows, cells, is_home, fps, distance, hot):
    """Deal the copies at hot anchors again by the third block; the anchor then has 36 bits and a mark."""
    again = np.isin(cells, hot)
    if not again.any():
        return rows, cells, is_home
    sub, code, over = _near(_block(fps[rows[again]], THIRD_BLOCK), distance)
    base, base_home = cells[again][sub], is_home[again][sub]
    new = (1 << 40) | base << 12 | code
    return (np.concatenate([rows[~again], rows[again][sub]]), np.concatenate([cells[~again], new]),
            np.concatenate([is_home[~again], base_home & (over == 0)]))


# ---------------------------------------------------------------- links

def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the links a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def compare_cells(cells: np.ndarray, fps: np.ndarray, is_home: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare, in each cell, its homes to all its fingerprints; yields star edges. Cells must be contiguous."""
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(cells)]]))
    group = np.repeat(np.arange(len(starts)), sizes)
    home = np.flatnonzero(is_home & (sizes[group] > 1))
    work = sizes[group[home]]
    done, total = 0, np.cumsum(work)
    while done < len(home):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS_AT_ONCE, side="right")))
        mine, n = home[done:stop], work[done:stop]
        left = np.repeat(mine, n)
        right = np.repeat(starts[group[mine]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = fps[left], fps[right]
        near = (np.bitwise_count(x ^ y) <= distance) & (x != y)
        if near.any():
            yield forest(x[near].view(np.int64), y[near].view(np.int64))
        done = stop


def links(distinct_fps: DataFrame, distance: int = 2) -> DataFrame:
    """Star edges (a, b) that join all distinct fingerprints ``fp`` within ``distance`` bits."""
    def home_cells(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(homes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))], names=["cell"])

    # At most one anchor in HOT_HOMES fingerprints can be hot: 8 bytes for every 4,096 distinct fingerprints.
    crowded = distinct_fps.select("fp").mapInArrow(home_cells, "cell long").groupBy("cell").count().where(F.col("count") > HOT_HOMES)
    hot = np.sort(np.array([r[0] for r in crowded.select("cell").collect()], np.int64))

    def deal(batches):
        for batch in batches:
            fps_all = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps_all), DEALT_AT_ONCE):
                fps = fps_all[at:at + DEALT_AT_ONCE]
                rows, cells, is_home = _refined(*anchors(fps, distance), fps, distance, hot)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(fps[rows].view(np.int64)), pa.array(is_home)],
                                                 names=["cell", "fp", "home"])

    def compare(batches):
        kept = None
        for batch in batches:
            now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64),
                   batch.column(2).to_numpy(zero_copy_only=False)]
            now = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last cell may go on in the next batch
            kept = [x[last:] for x in now]
            for a, b in compare_cells(*[x[:last] for x in now], distance) if last else ():
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if kept is not None and len(kept[0]):
            for a, b in compare_cells(*kept, distance):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = distinct_fps.select("fp").mapInArrow(deal, "cell long, fp long, home boolean")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp, component_id, kept) for every row.

    ``component_id`` is the smallest id that links reach; ``kept`` marks the rows of the one (id, text) that
    stands for its component.
    """
    if distance > 2:
        raise ValueError("the two-block covering is laid out for up to 2 differing bits")
    rows = written(fingerprints(docs, shingle, seed, id_col, text_col), "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))
    groups = written(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-distinct")
    roots = components(links(groups, distance))
    placed = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("best"))
    # Most components are one fingerprint: only fingerprints that moved need their component's first row.
    named = placed.join(firsts, "root").select("fp", "best")
    out = rows.join(named, "fp")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    return out.select("doc_id", "text_key", "fp", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` that stand for their component; of repeated rows one stays."""
    keys = (near_duplicates(docs, distance, shingle).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
            .distinct())
    tagged = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("of"), F.xxhash64("text").alias("of_text"))
    match = F.col("of").eqNullSafe(F.col("_id")) & (F.col("of_text") == F.col("_key"))
    return tagged.join(keys, match, "left_semi").dropDuplicates(["of", "of_text"]).select("row.*")
