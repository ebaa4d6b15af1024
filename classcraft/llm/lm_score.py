"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting: every task hashes its training tokens, sums equal words and word pairs, and deals the sums as sorted blocks to
shards by hash range. A shard adds its blocks and writes the exact word counts and its segment of the filter. A
gram of count c enters the filter once for each level 1 .. 1 + floor(log c / log `BASE`), so a gram's level is found by
probing level after level until one misses, and a level stands for the middle of its range of counts. A
filter never forgets a gram; it takes an unseen one for seen with a chance of about 2^-`HASHES` a probe, and pairs
are probed only if both words have a level. Levels up to a count that a gram is known to have (a word's exact count, a pair's
count in the block's own training texts) are in the filter and are not probed.

Score: sum over tokens of log10 P(w | v), with Dirichlet smoothing
P(w | v) = (c(v w) + MU P(w)) / (c(v) + MU) and P(w) = (c(w) + 1) / (N + V + 1), all counts from the filter.
The base score is the exact add-one unigram sum and needs the exact count of every word.

If filter and word counts take at most `MAX_BROADCAST` bytes they are broadcast and one scan scores all. Beyond that
nothing is broadcast: blocks of documents send their distinct grams to the shards, which answer with counts and levels,
and the answers meet their block again. Both ways give the same scores.

The number of shards follows the corpus: `SHARD_TEXT` bytes of text each, so a shard's blocks are bounded; a hot word
is one entry in a task's block however often it occurs. Words are told apart by 64-bit hashes.

Edge cases: a null text is empty and has one token, the end; with nothing to learn from every score is 0; a null id has
its own slice (crc of the empty text); repeated rows count as often as they occur; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classcraft.llm.common import written

SHARD_TEXT = 16 << 20
MIN_SHARDS = 12
TASK_TOKENS = 1 << 20           # training tokens a task holds before it sends their sums
BLOCK_TOKENS = 1 << 18          # tokens scored at once
MAX_BROADCAST = 256 << 20
BASE = math.sqrt(2.0)
HASHES = 7
BITS_PER_ENTRY = HASHES / math.log(2)
MU = 100.0
BEGIN, END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
_A, _B, _C = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * _A
        h = (h ^ (h >> np.uint64(33))) * _B
        return h ^ (h >> np.uint64(33))


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(first * _C + second + np.uint64(1))


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, and of the end."""
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the token before each, first token of each document)."""
    flat = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts[:-1]])]).astype(np.int64)
    before = np.concatenate([[BEGIN], flat[:-1]]).astype(np.uint64)
    before[starts] = BEGIN
    return flat, before, starts


def summed(grams: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if not len(grams):
        return grams.astype(np.uint64), np.empty(0, np.int64)
    if counts is None:
        grams = np.sort(grams)
        at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        return grams[at], np.diff(np.append(at, len(grams)))
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[at], np.add.reduceat(counts, at)


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """Shard by range of the hash, so it rises with the hash."""
    return ((grams >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _cuts(grams: np.ndarray, shards: int):
    shard = shard_of(grams, shards)
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist() if len(shard) else []
    for s, e in zip(at, at[1:] + [len(shard)]):
        yield int(shard[s]), slice(s, e)


# ---------------------------------------------------------------- the filter

def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def _count_table() -> np.ndarray:
    """Level -> the count it stands for: the middle of the whole numbers of its range (0 for none)."""
    out = [0.0]
    for level in range(1, 130):
        low, high = math.ceil(BASE ** (level - 1) - 1e-9), math.ceil(BASE ** level - 1e-9) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


COUNT_OF = _count_table()


def _probes(grams: np.ndarray, order: int, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = _mixed(grams + np.uint64(order) * _A + np.asarray(level, np.uint64) * _C)
    return h, _mixed(h ^ _B) | np.uint64(1)


def build_segment(grams_by_order: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Bits of one shard's segment as bytes."""
    levels = {o: level_of(c) for o, (_, c) in grams_by_order.items()}
    entries = sum(int(x.sum()) for x in levels.values())
    size = max(64, math.ceil(entries * BITS_PER_ENTRY))
    bits = np.zeros(-(-size // 8) * 8, np.uint8)
    m = np.uint64(len(bits))
    for order, (grams, _) in grams_by_order.items():
        for level in range(1, int(levels[order].max(initial=0)) + 1):
            h, step = _probes(grams[levels[order] >= level], order, level)
            for i in range(HASHES):
                with np.errstate(over="ignore"):
                    bits[(h + np.uint64(i) * step) % m] = 1
    return np.packbits(bits, bitorder="little")


class Filter:
    """Segments of a log-frequency Bloom filter, in the order of their shards."""

    def __init__(self, bits: np.ndarray, lengths: np.ndarray):
        """``bits``: the bytes of all shards' segments, ``lengths``: how many are each shard's (0: it has none)."""
        self.shards, self.bits = len(lengths), bits
        self.sizes = lengths.astype(np.uint64) * np.uint64(8)
        self.starts = (np.cumsum(lengths) - lengths).astype(np.uint64)

    def levels(self, grams: np.ndarray, order: int, least: np.ndarray | None = None) -> np.ndarray:
        """Levels of grams; ``least`` are counts that they are known to have at least: as the filter forgets nothing, the levels
        up to those counts are in it and need no probe."""
        out = np.zeros(len(grams), np.int64) if least is None else np.where(least > 0, level_of(least), 0)
        shard = shard_of(grams, self.shards)
        alive = np.flatnonzero(self.sizes[shard] > 0)
        while len(alive):
            size, start = self.sizes[shard[alive]], self.starts[shard[alive]]
            h, step = _probes(grams[alive], order, out[alive] + 1)
            there = np.arange(len(alive))
            for i in range(HASHES):
                with np.errstate(over="ignore"):
                    bit = (h[there] + np.uint64(i) * step[there]) % size[there]
                hit = self.bits[(start[there] + (bit >> np.uint64(3))).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
                there = there[hit == 1]
            alive = alive[there]
            out[alive] += 1
        return out


# ---------------------------------------------------------------- counting

def _count(shards: int, task_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            flat, before, starts = joined(held)
            for order, grams in ((0, np.full(len(starts), BEGIN, np.uint64)), (1, flat), (2, pair(before, flat))):
                grams, counts = summed(grams)
                for shard, part in _cuts(grams, shards):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int32()), pa.array([order], pa.int32()), pa.array([grams[part].tobytes()], pa.binary()),
                         pa.array([counts[part].astype(np.uint32).tobytes()], pa.binary())], names=["shard", "order", "grams", "counts"])

        for batch in batches:
            for text in batch.column(0):
                held.append(tokens(text.as_py()))
                size += len(held[-1])
                if size >= task_tokens:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()
    return run


def _gather(table: pa.Table) -> pa.Table:
    """All blocks of one shard: exact word counts, and the shard's segment of the filter."""
    blocks: dict[int, list] = {0: [], 1: [], 2: []}
    for order, grams, counts in zip(table.column("order").to_pylist(), table.column("grams"), table.column("counts")):
        blocks[order].append((np.frombuffer(grams.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32)))
    sums = {}
    for order, parts in blocks.items():
        sums[order] = summed(np.concatenate([p[0] for p in parts] or [np.empty(0, np.uint64)]),
                             np.concatenate([p[1] for p in parts] or [np.empty(0, np.uint32)]).astype(np.int64))
        parts.clear()
    words, counts = sums[1]
    segment = build_segment(sums)
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "words": pa.array([words.tobytes()], pa.binary()),
                     "counts": pa.array([counts.tobytes()], pa.binary()), "segment": pa.array([segment.tobytes()], pa.binary()),
                     "n_tokens": pa.array([int(counts.sum())], pa.int64()), "n_words": pa.array([len(words)], pa.int64())})


def count_grams(training: DataFrame, shards: int) -> DataFrame:
    """One row per shard: words (hashes), counts, segment, n_tokens, n_words."""
    blocks = training.select("text").mapInArrow(_count(shards, TASK_TOKENS), "shard int, order int, grams binary, counts binary")
    return written(blocks.groupBy("shard").applyInArrow(
        _gather, "shard int, words binary, counts binary, segment binary, n_tokens long, n_words long"), "lm-counts")


# ---------------------------------------------------------------- scoring

def scored(parts: list[np.ndarray], learned: np.ndarray, count, level, total: int, types: int):
    """(n_tokens, n_known, base score, score) of each document.

    ``learned``: the documents that the counts are from, ``count`` gives the exact counts of word hashes, ``level`` the filter levels of
    grams of an order that have at least the given counts.
    """
    flat, before, starts = joined(parts)
    words, which = np.unique(flat, return_inverse=True)
    exact = count(words)
    smooth = COUNT_OF[level(words, 1, exact)]
    space = total + types + 1
    base = np.log10((exact + 1) / space)[which]
    single = ((smooth + 1) / space)[which]
    context = np.empty(len(flat))
    context[1:] = smooth[which[:-1]]
    context[starts] = COUNT_OF[level(np.array([BEGIN]), 0, np.array([learned.sum()]))[0]]
    both = np.zeros(len(flat))
    maybe = np.flatnonzero((context > 0) & (smooth[which] > 0))
    # a frequent pair has many levels to probe: once a block is enough
    pairs, of_pair = np.unique(pair(before[maybe], flat[maybe]), return_inverse=True)
    sizes = np.diff(np.append(starts, len(flat)))
    least = np.bincount(of_pair[np.repeat(learned, sizes)[maybe]], minlength=len(pairs))
    both[maybe] = COUNT_OF[level(pairs, 2, least)][of_pair]
    both = np.minimum(both, context)
    full = np.log10((both + MU * single) / (context + MU))
    known = (exact > 0)[which].astype(np.int64)
    return sizes, np.add.reduceat(known, starts), np.add.reduceat(base, starts), np.add.reduceat(full, starts)


RESULT = "n_tokens long, n_known long, base_score double, score double"


def _batch(ids: pa.Array, found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in found[:2]), *(pa.array(x) for x in found[2:])],
                                      names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _blocks(batch: pa.RecordBatch, block_tokens: int):
    """(first row, tokens of the rows) of at most about ``block_tokens``."""
    held, size, first = [], 0, 0
    for row, text in enumerate(batch.column(1)):
        held.append(tokens(text.as_py()))
        size += len(held[-1])
        if size >= block_tokens:
            yield first, held
            held, size, first = [], 0, row + 1
    if held:
        yield first, held


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the sorted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.int64)


def _whole_model(model: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, counts, bits, length of each shard's bits) on the driver: shards arrive one partition at a time and are put in place."""
    sizes = np.zeros((shards, 2), np.int64)
    for r in model.select("shard", "n_words", F.octet_length("segment").alias("size")).collect():
        sizes[r.shard] = r.n_words, r.size
    word_at, byte_at = (np.cumsum(sizes, axis=0) - sizes).T
    total_words, total_bytes = sizes.sum(axis=0)
    words, counts, bits = np.empty(total_words, np.uint64), np.empty(total_words, np.int64), np.empty(total_bytes, np.uint8)
    for r in model.select("shard", "words", "counts", "segment").toLocalIterator():
        w, b = word_at[r.shard], byte_at[r.shard]
        words[w:w + sizes[r.shard, 0]] = np.frombuffer(r.words, np.uint64)
        counts[w:w + sizes[r.shard, 0]] = np.frombuffer(r.counts, np.int64)
        bits[b:b + sizes[r.shard, 1]] = np.frombuffer(r.segment, np.uint8)
    return words, counts if counts.max(initial=0) >> 32 else counts.astype(np.uint32), bits, sizes[:, 1].copy()


def _score_by_broadcast(docs: DataFrame, held_out: Column, model: DataFrame, shards: int, total: int, types: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_whole_model(model, shards))
    block_tokens = BLOCK_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, bits, lengths = shared.value
        bloom = Filter(bits, lengths)
        for batch in batches:
            for first, held in _blocks(batch, block_tokens):
                learned = batch.column(2).slice(first, len(held)).to_numpy(zero_copy_only=False)
                found = scored(held, learned, lambda w: lookup(words, counts, w), bloom.levels, total, types)
                yield _batch(batch.column(0).slice(first, len(held)), found)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.coalesce(~held_out, F.lit(False))).mapInArrow(run, f"doc_id {kind}, {RESULT}")


def _score_by_shards(docs: DataFrame, model: DataFrame, shards: int, total: int, types: int) -> DataFrame:
    kind, block_tokens = docs.schema["doc_id"].dataType.simpleString(), BLOCK_TOKENS

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, held in _blocks(batch, block_tokens):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([batch.column(0).slice(first, len(held)).to_pylist()], pa.list_(batch.schema.field(0).type)),
                     pa.array([[len(h) for h in held]], pa.list_(pa.int64())), pa.array([np.concatenate(held).tobytes()], pa.binary())],
                    names=["block", "ids", "sizes", "tokens"])
                number += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, flat in zip(batch.column(0), batch.column(1), batch.column(2)):
                flat = np.frombuffer(flat.as_buffer(), np.uint64)
                parts = np.split(flat, np.cumsum(np.array(sizes.as_py()))[:-1])
                _, before, _ = joined(parts)
                for order, grams in ((0, np.array([BEGIN], np.uint64)), (1, np.unique(flat)), (2, np.unique(pair(before, flat)))):
                    for shard, part in _cuts(grams, shards):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([shard], pa.int32()), pa.array([block.as_py()], pa.int64()), pa.array([order], pa.int32()),
                             pa.array([grams[part].tobytes()], pa.binary())], names=["shard", "block", "order", "grams"])

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "order": pa.array([], pa.int32()), "grams": pa.array([], pa.binary()),
                             "counts": pa.array([], pa.binary()), "levels": pa.array([], pa.binary())})
        words = counts = np.empty(0, np.uint64)
        bits, lengths = np.empty(0, np.uint8), np.zeros(shards, np.int64)
        if shard.num_rows:
            words = np.frombuffer(shard.column("words")[0].as_buffer(), np.uint64)
            counts = np.frombuffer(shard.column("counts")[0].as_buffer(), np.int64)
            bits = np.frombuffer(shard.column("segment")[0].as_buffer(), np.uint8)
            lengths[shard.column("shard")[0].as_py()] = len(bits)
        bloom = Filter(bits, lengths)
        found_counts, found_levels = [], []
        for order, grams in zip(asked.column("order").to_pylist(), asked.column("grams")):
            grams = np.frombuffer(grams.as_buffer(), np.uint64)
            exact = lookup(words, counts, grams) if order == 1 else None
            found_counts.append(exact.astype(np.int64).tobytes() if order == 1 else b"")
            found_levels.append(bloom.levels(grams, order, exact).astype(np.int16).tobytes())
        return pa.table({"block": asked.column("block"), "order": asked.column("order"), "grams": asked.column("grams"),
                         "counts": pa.array(found_counts, pa.binary()), "levels": pa.array(found_levels, pa.binary())})

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        flat = np.frombuffer(block.column("tokens")[0].as_buffer(), np.uint64)
        parts = np.split(flat, np.cumsum(np.array(block.column("sizes")[0].as_py()))[:-1])
        known = {}
        for order in (0, 1, 2):
            rows = answers.filter(pc.equal(answers.column("order"), order))
            grams = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("grams")] or [np.empty(0, np.uint64)])
            levels = np.concatenate([np.frombuffer(x.as_buffer(), np.int16) for x in rows.column("levels")] or [np.empty(0, np.int16)]).astype(np.int64)
            counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("counts")] or [np.empty(0, np.int64)])
            sort = np.argsort(grams)
            known[order] = grams[sort], levels[sort], counts[sort] if order == 1 else None
        found = scored(parts, np.zeros(len(parts), bool), lambda w: lookup(known[1][0], known[1][2], w), lambda g, order, _: lookup(*known[order][:2], g), total, types)
        ids = block.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.Table.from_batches([_batch(ids.flatten(), found)])

    table = written(docs.select("doc_id", "text").mapInArrow(blocks, f"block long, ids array<{kind}>, sizes array<long>, tokens binary"), "lm-blocks")
    asked = table.select("block", "sizes", "tokens").mapInArrow(ask, "shard int, block long, order int, grams binary")
    answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(
        answer, "block long, order int, grams binary, counts binary, levels binary")
    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, {RESULT}")


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every text, learning from rows that aren't ``held_out``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(MIN_SHARDS, -(-size // SHARD_TEXT))
    model = count_grams(docs.where(~held_out), shards)
    total, types, bytes_ = model.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0)),
                                     F.coalesce(F.sum(F.octet_length("segment") + 2 * F.octet_length("words")), F.lit(0))).first()
    if bytes_ <= MAX_BROADCAST:
        out = _score_by_broadcast(docs, held_out, model, shards, total, types)
    else:
        out = _score_by_shards(docs, model, shards, total, types)
    return out.withColumn("train_tokens", F.lit(total).cast("long"))
