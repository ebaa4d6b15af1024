"""Removal of repeated byte strings by suffix order over shards.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a document of
smaller id, or further left in the same). Every string of that length has one anchor, its least 32-byte gram by
hash, so equal strings have equal anchors. Neighbouring starts with one anchor form a segment, the text
that holds their strings:

1. One scan cuts every document into segments: hash of the anchor, hash of the segment, place.
2. Equal segments are merged, first in the scanning task, then by shuffle; every later copy repeats in whole. A
   first copy whose anchor also stands in some other segment may repeat in part.
3. Those segments are cut from the texts and dealt to shards by anchor, about `SHARD_BYTES` each by total bytes, since a task
   holds its shard in memory (only the queue's lanes go to disk). Each shard is
   sorted by external induced sorting (`induced`); suffixes with a common prefix of ``length`` bytes are
   equal strings, of which all but the earliest repeat.
4. The repeating strings of a document are united and their bytes removed.

An anchor in more than `HOT_SEGMENTS` different segments (a passage all documents share, each in its own
surroundings) would make one shard grow: its strings go one by one through step 2 instead, by 128-bit hash.

Edge cases: a null text counts as empty; documents shorter than ``length`` are kept whole; matches never
cross documents; null ids come last; repeated rows (same id and text) are one document and each gets its
result; rows of one id with different texts are ordered by a hash of the text; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classcraft.llm.common import written
from classcraft.llm.induced import falling_suffixes

GRAM = 32
SLICE = 1 << 19                # bytes hashed at once
ROWS_AT_ONCE = 1 << 18         # segments merged at once in a scanning task
SHARD_BYTES = 2 << 20
MEMORY_ITEMS = 1 << 20         # suffix tuples that a shard's queue holds before it goes to disk
HOT_SEGMENTS = 20_000
LAST_ID = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)

SEGMENT = "key long, seg long, doc long, ver long, lo long, n int, again boolean"
FOUND = "kind int, key long, doc long, ver long, lo long, n int"


# ---------------------------------------------------------------- 1. segments

def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position that has as many."""
    h, width, power = _TABLE[data], 1, np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def segments(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, number of starts) of the pieces [first, last) of ``data``; no string crosses a piece."""
    hashes = gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
    window, have = length - GRAM + 1, 1
    while have < window:
        step = min(have, window - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    counts = last - first - length + 1
    use = counts > 0
    first, counts = first[use], counts[use]
    starts = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    anchor = (least[starts] & low).astype(np.int64)
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at = np.flatnonzero(fresh)
    return hashes[anchor[at]].view(np.int64), starts[at], np.diff(np.append(at, len(starts)))


def _as_batch(cols: list[np.ndarray], again) -> pa.RecordBatch:
    key, seg, doc, ver, lo, n = cols
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(seg), pa.array(doc), pa.array(ver), pa.array(lo), pa.array(n.astype(np.int32)),
         pa.array(np.full(len(key), again, bool))], names=["key", "seg", "doc", "ver", "lo", "n", "again"])


def _joined_runs(doc, ver, lo, n):
    """Unite neighbouring runs of starts of one document."""
    order = np.lexsort((lo, ver, doc))
    doc, ver, lo, n = doc[order], ver[order], lo[order], n[order].astype(np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (ver[1:] != ver[:-1]) | (lo[1:] != lo[:-1] + n[:-1])])
    at = np.flatnonzero(new)
    return doc[at], ver[at], lo[at], np.add.reduceat(n, at) if len(at) else n


def merge_in_task(rows: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """First copies of the segments a task has seen, and runs of later copies under a spread key."""
    cols = [np.concatenate(c) for c in zip(*rows)]
    with np.errstate(over="ignore"):
        both = cols[0].view(np.uint64) * _MIX + cols[1].view(np.uint64)
    order = np.argsort(both)
    sorted_both = both[order]
    next_same = np.append(sorted_both[1:] == sorted_both[:-1], False)
    tied = next_same | np.concatenate([[False], next_same[:-1]])
    single = order[~tied]
    yield _as_batch([c[single] for c in cols], False)
    if tied.any():
        key, seg, doc, ver, lo, n = (c[order[tied]] for c in cols)
        sort = np.lexsort((lo, ver, doc, seg, key))
        key, seg, doc, ver, lo, n = (c[sort] for c in (key, seg, doc, ver, lo, n))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])])
        place = np.concatenate([[True], (doc[1:] != doc[:-1]) | (ver[1:] != ver[:-1]) | (lo[1:] != lo[:-1])])
        yield _as_batch([c[new] for c in (key, seg, doc, ver, lo, n)], False)
        later = ~new & place
        if later.any():
            doc, ver, lo, n = _joined_runs(doc[later], ver[later], lo[later], n[later])
            with np.errstate(over="ignore"):
                spread = ((doc.view(np.uint64) + lo.view(np.uint64)) * _MIX).view(np.int64)
            yield _as_batch([spread, spread, doc, ver, lo, n], True)


def _scan(length: int, slice_bytes: int, rows_at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            versions = batch.column(1).to_numpy(zero_copy_only=False)
            for rows, base, parts in _slices(batch.column(2), length, slice_bytes):
                data = np.frombuffer(b"".join(parts), np.uint8)
                sizes = np.array([len(p) for p in parts])
                ends = np.cumsum(sizes)
                key, at, n = segments(data, ends - sizes, ends, length)
                view, stop = memoryview(data), at + n + (length - 1)
                seg = np.array([xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(at.tolist(), stop.tolist())], np.uint64).view(np.int64)
                piece = np.searchsorted(ends, at, side="right")
                row = np.array(rows)[piece]
                held.append([key, seg, doc_ids[row], versions[row], np.array(base)[piece] + at - (ends - sizes)[piece], n])
                count += len(key)
                if count >= rows_at_once:
                    yield from merge_in_task(held)
                    held, count = [], 0
        if count:
            yield from merge_in_task(held)
    return run


def _slices(texts: pa.Array, length: int, slice_bytes: int):
    """Pieces of the texts, about ``slice_bytes`` at a time: (rows, first byte of each, bytes)."""
    rows, bases, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        raw = (text.as_py() or "").encode()
        for base in range(0, len(raw) - length + 1, slice_bytes):
            part = raw[base:base + slice_bytes + length - 1]
            rows.append(row)
            bases.append(base)
            parts.append(part)
            size += len(part)
            if size >= slice_bytes:
                yield rows, bases, parts
                rows, bases, parts, size = [], [], [], 0
    if parts:
        yield rows, bases, parts


# ---------------------------------------------------------------- 2. equal segments

def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, seg, doc, ver, lo): later copies (kind 0) and first copies whose anchor has other segments (1).

    What is carried from batch to batch is one row, however large a group is.
    """
    before = None      # last row: key, seg, doc, ver, lo
    pending = None     # last first-copy: key, doc, ver, lo, n, and whether the first copy before it had its key

    def rows(kind, key, doc, ver, lo, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), *map(pa.array, (key, doc, ver, lo)),
                                           pa.array(n.astype(np.int32))], names=["kind", "key", "doc", "ver", "lo", "n"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        again = batch.column(6).to_numpy(zero_copy_only=False)
        if again.any():
            key, _, doc, ver, lo, n = (c[again] for c in cols)
            yield rows(0, key, doc, ver, lo, n)
            cols = [c[~again] for c in cols]
        key, seg, doc, ver, lo, n = cols
        if not len(key):
            continue
        lead = before or [None] * 5
        prev = [np.concatenate([[c[0] if v is None else v], c[:-1]]) for c, v in zip((key, seg, doc, ver, lo), lead)]
        new = (key != prev[0]) | (seg != prev[1])
        place = (doc != prev[2]) | (ver != prev[3]) | (lo != prev[4])
        if before is None:
            new[0] = True
        before = [key[-1], seg[-1], doc[-1], ver[-1], lo[-1]]
        later = ~new & place
        if later.any():
            d, v, s, k = _joined_runs(doc[later], ver[later], lo[later], n[later])
            yield rows(0, np.zeros(len(d), np.int64), d, v, s, k)
        first = [c[new] for c in (key, doc, ver, lo, n)]
        if not len(first[0]):
            continue
        shared = np.zeros(len(first[0]), bool)
        if pending is not None:
            first = [np.concatenate([[p], c]).astype(np.int64) for p, c in zip(pending[:5], first)]
            shared = np.concatenate([[pending[5]], shared])
        same = first[0][1:] == first[0][:-1]
        shared[1:] |= same
        shared[:-1] |= same
        pending = [c[-1] for c in first] + [bool(shared[-1])]
        need = shared[:-1]
        if need.any():
            yield rows(1, *(c[:-1][need] for c in first))
    if pending is not None and pending[5]:
        yield rows(1, *(np.array([p], np.int64) for p in pending[:5]))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "seg", "doc", "ver", "lo").mapInArrow(_merge, FOUND)


# ---------------------------------------------------------------- 3. shards

def _cut(shards: int, hot: np.ndarray, length: int):
    """Cut the segments of cold anchors from their texts and deal them to shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw, cuts = (batch.column(2)[row].as_py() or "").encode(), batch.column(3)[row].values
                key, lo, n = (cuts.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                use = ~np.isin(key, hot)
                key, lo, n = key[use], lo[use], n[use]
                if not len(key):
                    continue
                parts = [raw[s:s + k + length - 1] for s, k in zip(lo.tolist(), n.tolist())]
                size = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key.view(np.uint64) % np.uint64(shards)).astype(np.int64)), pa.array(np.full(size, batch.column(0)[row].as_py(), np.int64)),
                     pa.array(np.full(size, batch.column(1)[row].as_py(), np.int64)), pa.array(lo), pa.array(n.astype(np.int32)),
                     pa.array(parts, pa.binary())], names=["shard", "doc", "ver", "lo", "n", "bytes"])
    return run


def _cut_hot(hot: np.ndarray, length: int):
    """The single strings of hot anchors, each under the two halves of its 128-bit hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                raw, cuts = (batch.column(2)[row].as_py() or "").encode(), batch.column(3)[row].values
                key, lo, n = (cuts.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                use = np.isin(key, hot)
                for s, k in zip(lo[use].tolist(), n[use].tolist()):
                    starts = np.arange(s, s + k, dtype=np.int64)
                    both = [xxhash.xxh3_128_intdigest(raw[i:i + length]) for i in starts.tolist()]
                    halves = [np.array([x >> shift & (1 << 64) - 1 for x in both], np.uint64).view(np.int64) for shift in (0, 64)]
                    held.append([*halves, np.full(k, batch.column(0)[row].as_py(), np.int64),
                                 np.full(k, batch.column(1)[row].as_py(), np.int64), starts, np.ones(k, np.int64)])
                    count += k
            if count >= ROWS_AT_ONCE:
                yield from merge_in_task(held)
                held, count = [], 0
        if count:
            yield from merge_in_task(held)
    return run


def repeats_in_shard(doc, ver, lo, n, data: np.ndarray, offsets: np.ndarray, length: int, memory: int):
    """(doc, ver, first start, number of starts) of the strings that also start earlier, among a shard's segments."""
    sizes = np.diff(offsets)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.full(int(sizes.sum()) + len(sizes), 255, np.uint8)  # 255 ends a segment: UTF-8 has no such byte
    for at, start, size in zip(begin.tolist(), offsets.tolist(), sizes.tolist()):
        text[at:at + size] = data[start:start + size]
    order = np.lexsort((ver, doc))
    changed = np.concatenate([[False], (doc[order][1:] != doc[order][:-1]) | (ver[order][1:] != ver[order][:-1])])
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(changed)
    positions, groups, group, carry = [], [], 0, None
    for chunk in falling_suffixes(text, length, memory):
        # a suffix is in a group if it shares the string with the one before or after it
        chunk = chunk if carry is None else np.concatenate([carry, chunk])
        same = chunk["lcp"] >= length
        carry = chunk[-1:]
        ids = group + np.cumsum(~same)
        member = np.append(same[:-1] | same[1:], False)
        positions.append(chunk["pos"][member])
        groups.append(ids[member])
        if same[-1]:  # counted now, and not again as the next chunk's first
            positions.append(chunk["pos"][-1:])
            groups.append(ids[-1:])
        group = int(ids[-1]) - int(not same[-1])
    pos, group_of = np.concatenate(positions or [np.empty(0, np.int64)]), np.concatenate(groups or [np.empty(0, np.int64)])
    pos, at = np.unique(pos, return_index=True)
    group_of = group_of[at]
    segment = np.searchsorted(begin, pos, side="right") - 1
    inside = pos - begin[segment]
    whole = inside < n[segment]
    pos, group_of, segment, inside = pos[whole], group_of[whole], segment[whole], inside[whole]
    sort = np.lexsort((lo[segment] + inside, rank[segment], group_of))
    group_of, segment, inside = group_of[sort], segment[sort], inside[sort]
    later = np.concatenate([[False], group_of[1:] == group_of[:-1]]) if len(group_of) else np.empty(0, bool)
    segment, inside = segment[later], inside[later]
    return _joined_runs(*_dedup(doc[segment], ver[segment], lo[segment] + inside))


def _dedup(doc, ver, start):
    order = np.lexsort((start, ver, doc))
    doc, ver, start = doc[order], ver[order], start[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (ver[1:] != ver[:-1]) | (start[1:] != start[:-1])])[:len(doc)]
    return doc[new], ver[new], start[new], np.ones(int(new.sum()), np.int64)


def _sort_shard(length: int, memory: int):
    def run(table: pa.Table) -> pa.Table:
        place = np.lexsort([table.column(c).to_numpy() for c in ("lo", "ver", "doc")])
        table = table.take(place)
        # repeated rows of the input bring a segment more than once
        same = np.concatenate([[False], np.logical_and.reduce([np.diff(table.column(c).to_numpy()) == 0 for c in ("doc", "ver", "lo")])])
        table = table.filter(pa.array(~same)).combine_chunks()
        cols = {c: table.column(c).to_numpy() for c in ("doc", "ver", "lo")}
        n = table.column("n").to_numpy().astype(np.int64)
        binary = table.column("bytes").combine_chunks()
        binary = (binary.chunk(0) if isinstance(binary, pa.ChunkedArray) else binary).cast(pa.large_binary())
        offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset:binary.offset + len(binary) + 1]
        data = np.frombuffer(binary.buffers()[2], np.uint8)
        doc, ver, lo, k = repeats_in_shard(cols["doc"], cols["ver"], cols["lo"], n, data, offsets, length, memory)
        return pa.table({"doc": doc, "ver": ver, "lo": lo, "n": k.astype(np.int32)})
    return run


# ---------------------------------------------------------------- 4. removal

def covered(starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [from, to) covered by ``counts`` strings from ``starts`` on; touching runs are one."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], (starts + counts + (length - 1))[order]
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return begin[at], reach[np.append(at[1:] - 1, len(begin) - 1)]


def removed(text: str | None, marks, length: int) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """(bytes left, first bytes and ends of the removed runs, bytes there were)."""
    raw = (text or "").encode()
    if marks is None or not len(marks):
        return raw, np.empty(0, np.int64), np.empty(0, np.int64), len(raw)
    lo, n = (marks.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    begin, end = covered(lo, n, length)
    left = np.concatenate([[0], end]), np.concatenate([begin, [len(raw)]])
    return b"".join(raw[s:e] for s, e in zip(*(x.tolist() for x in left))), begin, end, len(raw)


SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def _removal(length: int):
    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept: binary, spans: array<struct<start: bigint, length: bigint>>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, marks in batches:
            kept, spans, sizes = [], [], []
            for text, mark in zip(texts, marks):
                left, begin, end, size = removed(text.as_py(), mark.values if mark.is_valid else None, length)
                kept.append(left)
                sizes.append(size)
                spans.append([{"start": b, "length": e - b} for b, e in zip(begin.tolist(), end.tolist())])
            n = pa.array(sizes, pa.int64())
            yield pa.StructArray.from_arrays(
                [n, pa.array([s - len(k) for s, k in zip(sizes, kept)], pa.int64()), pa.array([len(x) for x in spans], pa.int64()),
                 pa.array(kept, pa.binary()), pa.array(spans, pa.list_(SPAN))],
                names=["n_bytes", "n_removed", "n_spans", "kept", "spans"])
    return run


def _text_left(length: int):
    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, marks in batches:
            yield pa.array([None if not text.is_valid else removed(text.as_py(), mark.values if mark.is_valid else None, length)[0]
                            .decode("utf-8", "ignore") for text, mark in zip(texts, marks)], pa.string())
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc, ver, text): ``ver`` tells texts of one id apart and is 0 where an id has one text."""
    base = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
                       F.col("text").cast("string").alias("text"))
    texts = base.groupBy("doc").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    several = texts.where("a <> b").select(F.col("doc").alias("several"))
    if several.isEmpty():
        return base.withColumn("ver", F.lit(0).cast("long"))
    return (base.join(several, F.col("doc") == F.col("several"), "left")
            .withColumn("ver", F.when(F.col("several").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")).drop("several"))


def repeated(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, ver, marks): by document the runs (lo, n) of starts whose strings also start earlier."""
    if length < 2 * GRAM:
        raise ValueError(f"strings must have {2 * GRAM} bytes at least")
    keyed = _keyed(docs)
    texts = keyed.select("doc", "ver", "text")
    found = written(_merged(texts.mapInArrow(_scan(length, SLICE, ROWS_AT_ONCE), SEGMENT)), "suffix-segments")
    cut = found.where("kind = 1")
    # Bounded by the number of cut segments / HOT_SEGMENTS: 8 bytes each.
    hot = np.array([r[0] for r in cut.groupBy("key").count().where(F.col("count") > HOT_SEGMENTS).select("key").collect()], np.int64)
    total = cut.agg(F.sum(F.col("n") + length)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    cuts = cut.groupBy("doc", "ver").agg(F.collect_list(F.struct("key", "lo", "n")).alias("cuts"))
    joined = texts.join(cuts, ["doc", "ver"]).select("doc", "ver", "text", "cuts")
    pieces = joined.mapInArrow(_cut(shards, hot, length), "shard long, doc long, ver long, lo long, n int, bytes binary")
    marks = found.where("kind = 0").select("doc", "ver", "lo", "n").unionByName(
        pieces.groupBy("shard").applyInArrow(_sort_shard(length, MEMORY_ITEMS), "doc long, ver long, lo long, n int"))
    if len(hot):
        single = _merged(joined.mapInArrow(_cut_hot(hot, length), SEGMENT))
        marks = marks.unionByName(single.where("kind = 0").select("doc", "ver", "lo", "n"))
    return marks.groupBy("doc", "ver").agg(F.collect_list(F.struct("lo", "n")).alias("marks"))


def _marked(docs: DataFrame, length: int) -> DataFrame:
    marks, keyed = repeated(docs, length).alias("m"), _keyed(docs).alias("d")
    return keyed.join(marks, (F.col("d.doc") == F.col("m.doc")) & (F.col("d.ver") == F.col("m.ver")), "left")


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, spans): what is left of every document."""
    out = _removal(length)(F.col("d.text"), F.col("marks"))
    return _marked(docs, length).select(F.col("row.doc_id").alias("doc_id"), out.alias("out")).select("doc_id", "out.*")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with the repeats taken from ``text`` (a character cut in two goes whole); ``n_chars`` follows if there."""
    left = _marked(docs, length).select("row", _text_left(length)(F.col("d.text"), F.col("marks")).alias("left"))
    new = {"text": F.col("left"), "n_chars": F.when(F.col("left").isNotNull(), F.length("left"))}
    return left.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
