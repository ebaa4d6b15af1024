from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from classcraft.llm import lm_score
from classcraft.llm.common import table
from classcraft.llm.queries import op3_lm_score

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


def brute(rows, held):
    """doc -> (n_tokens, n_known, base, score with true quantised counts, score with true counts)."""
    single, double, begins = Counter(), Counter(), 0
    for i, text in rows:
        if not held[i]:
            line = words(text)
            single.update(line)
            double.update(zip(["<s>"] + line, line))
            begins += 1
    total, types = sum(single.values()), len(single)
    quant = lambda c: float(lm_score.COUNT_OF[lm_score.level_of(np.array([c]))[0]]) if c else 0.0
    out = {}
    for i, text in rows:
        line = words(text)
        base = sum(math.log10((single[w] + 1) / (total + types + 1)) for w in line)
        scores = []
        for count in (quant, float):
            s = 0.0
            for v, w in zip(["<s>"] + line, line):
                context = count(begins if v == "<s>" else single[v])
                both = min(count(double[v, w]), context)
                s += math.log10((both + lm_score.MU * (count(single[w]) + 1) / (total + types + 1)) / (context + lm_score.MU))
            scores.append(s)
        out[i] = (len(line), sum(single[w] > 0 for w in line), base, *scores)
    return out, total


@pytest.mark.parametrize("limit", [lm_score.MAX_BROADCAST, 0])
def test_whole_table_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(lm_score, "MAX_BROADCAST", limit)
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 5000)
    monkeypatch.setattr(lm_score, "TASK_TOKENS", 7000)
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    want, total = brute(rows, held)
    got = op3_lm_score(spark, SF).collect()
    assert len(got) == len(rows)
    gaps = []
    for r in got:
        n, known, base, quantised, true = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held[r.doc_id])
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        gaps.append(abs(r.score - quantised) / n)
        assert r.score < 0 and abs(r.score - true) / n < 0.4  # repeated lines repeat a false positive
    assert np.mean(gaps) < 0.02  # what false positives of the filter cost, log10 a token


def test_filter_forgets_nothing_and_errs_rarely():
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    counts = rng.geometric(0.3, len(grams))
    segment = lm_score.build_segment({1: (grams, counts), 2: (grams[:5], counts[:5])})
    bloom = lm_score.Filter(segment, np.array([len(segment)]))
    level = lm_score.level_of(counts)
    found = bloom.levels(grams, 1)
    assert (found >= level).all() and (found > level).mean() < 0.02
    other = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert (bloom.levels(other, 1) > 0).mean() < 0.02


def test_levels_of_known_counts_are_not_probed(monkeypatch):
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 1 << 63, 5_000, dtype=np.uint64))
    counts = rng.geometric(0.02, len(grams))
    segment = lm_score.build_segment({1: (grams[:0], counts[:0]), 2: (grams, counts)})
    bloom = lm_score.Filter(segment, np.array([len(segment)]))
    other = rng.integers(0, 1 << 63, 1_000, dtype=np.uint64)
    probed, probes = [], lm_score._probes
    monkeypatch.setattr(lm_score, "_probes", lambda g, *args: probed.append(len(g)) or probes(g, *args))
    whole = bloom.levels(np.append(grams, other), 2)
    before, probed[:] = sum(probed), []
    assert (bloom.levels(np.append(grams, other), 2, np.append(counts - counts // 8, 0 * other.astype(np.int64))) == whole).all()
    assert sum(probed) < before / 4


def test_scores_do_not_depend_on_which_texts_are_known_to_be_learned(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [lm_score.tokens(" ".join(f"w{i}" for i in rng.zipf(1.5, 40) % 50)) for _ in range(30)]
    flat, before, starts = lm_score.joined(texts)
    sums = {o: lm_score.summed(g) for o, g in ((0, np.full(len(starts), lm_score.BEGIN, np.uint64)), (1, flat), (2, lm_score.pair(before, flat)))}
    segment = lm_score.build_segment(sums)
    bloom = lm_score.Filter(segment, np.array([len(segment)]))
    given = (lambda w: lm_score.lookup(*sums[1], w), bloom.levels, len(flat), len(sums[1][0]))
    found = [lm_score.scored(texts, np.arange(30) % k == 0, *given) for k in (1, 3, 31)]
    assert all((a == b).all() for other in found[1:] for a, b in zip(found[0], other))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "A b a"), (3, "A b a"), (None, "a b"), (4, "z " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as score", "2 as shard")
    from classcraft.llm.common import crc_slice

    got = lm_score.score(docs, crc_slice("doc_id", 7) == 2).collect()
    assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id == 1} == {1}
    assert lm_score.score(docs.limit(0), crc_slice("doc_id", 7) == 2).count() == 0
    from pyspark.sql import functions as F

    none = lm_score.score(docs, F.lit(True)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in none)
