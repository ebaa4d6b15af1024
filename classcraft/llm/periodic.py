"""Periodic runs of words in a text: an online sparse dynamic programme over diagonals.

A run is a stretch of words with smallest period q (words q apart are equal) of at least ``max(SHORTEST, POWER * q)`` words
that no neighbouring word extends. Diagonal q holds, at word i, the match length m(i, q): how many words up to
i equal the word q before them. A word's earlier occurrences increment the lengths of the lags at which they lie; a
diagonal that ends with m + q words or more than a run needs emits the run [i - m - q + 1, i].

Sparse: a run of period q matches 3q words in a row, so for lags in [L, 2L), L a power of two, only occurrences of the
whole last 3L words count. Of these only the last one can lie at the smallest period: if words i - 3L + 1 .. i also occurred p < q
before i, both p and q would be periods of 3L + p >= p + q words, so (Fine and Wilf) their divisor would be one, and q would not be
smallest. Each word therefore increments at most one diagonal a level, there are log2(n / 4) levels, and only
words whose shorter grams were seen before stay for the next level: ordinary text needs about one pass, a text
of one repeated word n log n steps, where counting all earlier occurrences would take n^2 / 2. Grams are named exactly
(pairs of names of their halves), not hashed. The texts of an Arrow batch are worked on together; a word's names hold its text.

``periodic_runs`` adds to each row ``n_words``, ``runs`` (array of start, length, period by start, then period) and ``collapsed``: the
words in no run after that run's first period, joined by one space. Words are separated by space and 0x09-0x0D.

Edge cases: a null or empty text, or one of white space, has no words, no runs and the collapsed text ''; texts of any length are
worked on whole, by themselves if longer than ``BATCH_BYTES``; runs of different smallest periods may overlap, and a word is
dropped if any of them says so; repeated rows give the same result each; an empty table gives an empty one; other columns
stay, but for columns of the names added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORTEST, POWER = 6, 4       # words and periods that a run has at least
BATCH_BYTES = 4 << 20        # texts worked on together
RUNS = "array<struct<start: long, length: long, period: long>>"


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names from 1 of the pairs that occur twice or more; 0 for other pairs and where a half has no name."""
    out = np.zeros(len(left), np.int64)
    at = np.flatnonzero((left > 0) & (right > 0))
    if len(at):
        _, inverse, counts = np.unique(left[at] * (int(right.max()) + 1) + right[at], return_inverse=True, return_counts=True)
        names = np.zeros(len(counts), np.int64)
        again = counts > 1
        names[again] = np.arange(1, again.sum() + 1)
        out[at] = names[inverse]
    return out


def _moved(names: np.ndarray, by: int) -> np.ndarray:
    """names[i - by], 0 where there is none."""
    out = np.zeros_like(names)
    if by < len(names):
        out[by:] = names[:len(names) - by]
    return out


def _lags(names: np.ndarray) -> np.ndarray:
    """How far back each named gram occurred last; 0 if never."""
    out = np.zeros(len(names), np.int64)
    at = np.flatnonzero(names)
    if len(at):
        order = at[np.argsort(names[at], kind="stable")]
        same = names[order[1:]] == names[order[:-1]]
        out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, positive numbers; by start, then period.

    Several texts may lie one behind the other if no word has the same number in two of them.
    """
    words = np.asarray(words, np.int64)
    found = []
    halves, level = _named(words, np.ones(len(words), np.int64)), 1   # names of the last `level` words
    while level * POWER <= len(words) and halves.any():
        doubled = _named(_moved(halves, level), halves)
        lags = _lags(_named(_moved(doubled, level), halves))             # the last 3 * level words
        lags[(lags < level) | (lags >= 2 * level)] = 0
        # the diagonals: words in a row that increment the same lag
        starts = np.flatnonzero((lags > 0) & (lags != _moved(lags, 1)))
        if len(starts):
            ends = np.flatnonzero((lags > 0) & (lags != np.append(lags[1:], 0)))
            lag = lags[starts]
            matched = ends - starts + 3 * level
            enough = matched + lag >= np.maximum(SHORTEST, POWER * lag)
            found += zip((ends - matched - lag + 1)[enough].tolist(), (matched + lag)[enough].tolist(), lag[enough].tolist())
        halves, level = doubled, 2 * level
    return sorted(found, key=lambda r: (r[0], r[2]))


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """The words of all texts as numbers from 1, different ones in each text."""
    numbers: list[int] = []
    first = 1
    for words in texts:
        known: dict[bytes, int] = {}
        numbers += [known.setdefault(w, first + len(known)) for w in words]
        first += len(known)
    return np.array(numbers, np.int64)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words)


def _work(texts: list[bytes | None]) -> Iterator[tuple[int, list[dict], bytes]]:
    split = [t.split() if t else [] for t in texts]
    firsts = np.cumsum([0] + [len(w) for w in split])
    of_text: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, period in runs_of(_numbered(split)):
        i = int(np.searchsorted(firsts, start, "right")) - 1
        of_text.setdefault(i, []).append((start - int(firsts[i]), length, period))
    for i, words in enumerate(split):
        runs = of_text.get(i, [])
        yield len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], _collapsed(words, runs)


def _slices(sizes: list[int]) -> Iterator[slice]:
    first = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH_BYTES:
            yield slice(first, i)
            first, held = i, 0
        held += n
    yield slice(first, len(sizes))


def periodic_runs(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with n_words, runs and collapsed of the texts in ``column``."""
    added = ("n_words", "runs", "collapsed")
    run = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in added]
    given = df.select(*rest, F.col(f"`{column}`").cast("string").alias("__text"))

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(whole.num_columns - 1)), 0).to_pylist()
            for part in _slices(sizes):
                batch = whole.slice(part.start, part.stop - part.start)
                n_words, runs, collapsed = [], [], []
                for n, found, left in _work(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()):
                    n_words.append(n)
                    runs.append(found)
                    collapsed.append(left)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=[*batch.schema.names[:-1], *added])

    schema = T.StructType([*given.schema.fields[:-1], *T.StructType.fromDDL(f"n_words long, runs {RUNS}, collapsed string").fields])
    return given.mapInArrow(worked, schema)


def planted(doc_id: str = "doc_id", text: str = "text"):
    """The text of the contract: in one document of ten (by crc32 of its id) the words from one on repeat with some period."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    body = F.coalesce(F.regexp_replace(F.col(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""), F.lit(""))

    def repeated(words):
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1),
                                        lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.split(body, r"[\x20\x09-\x0D]+")
    # a one-element array binds the split words to a name, so that they are split once
    changed = F.element_at(F.transform(F.array(words), repeated), 1)
    return F.when((h % 10 == 0) & (F.length(body) > 0), changed).otherwise(F.col(text))


def digests(worked: DataFrame) -> DataFrame:
    """The columns of the contract from doc_id, runs and collapsed."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = worked.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, best).alias("b"))
    length = -F.col("b.l")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.s").alias("start"), length.alias("length"), F.col("b.p").alias("period"),
                       F.floor(F.lit(1000) * length / F.col("b.p")).alias("exponent_milli"),
                       F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
