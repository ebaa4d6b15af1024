from __future__ import annotations

import re

import numpy as np

from classcraft.llm import quality
from classcraft.llm.common import table
from classcraft.llm.queries import op4_quality

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_statistics_against_brute_force():
    rng = np.random.default_rng(5)
    texts = [None, "", " \n ", "a", "a a a a", "a b c a b c", "x\ny\nx\n x\n\n\ny", "é # *\n|é # *", "a\x0bb\x0cc\r\nd"]
    texts += ["".join(rng.choice(list("ab \n#é\t"), int(rng.integers(1, 120)))) for _ in range(300)]
    for text in texts:
        assert quality.statistics(text) == brute(text), repr(text)


def test_chi_square():
    assert abs(quality.chi2_quantile(0.975, 5) - 12.8325) < 1e-3 and abs(quality.chi2_cdf(3.0, 2) - (1 - np.exp(-1.5))) < 1e-12


def test_whole_table(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = op4_quality(spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        if len(texts[r.doc_id]) < 3000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_estimates_resist_a_fifth_of_junk_and_match_brute_force(spark):
    rng = np.random.default_rng(11)
    mix = rng.normal(size=(quality.K, quality.K))
    clean = rng.normal(size=(800, quality.K)) @ mix * 2 + 5
    junk = rng.normal(size=(200, quality.K)) * 0.2 + 60
    z = np.concatenate([clean, junk])
    df = spark.createDataFrame([("g", list(map(float, v))) for v in z], "grp string, z array<double>")
    got = quality.fit(df.repartition(3)).first()
    assert np.abs(np.array(got.center) - clean.mean(axis=0)).max() < 0.6
    inverse = np.array(got.inverse).reshape(quality.K, quality.K)
    diff = z - np.array(got.center)
    d2 = np.einsum("ij,jk,ik->i", diff, inverse, diff)
    assert (d2[800:] > quality.chi2_quantile(quality.CUTOFF, quality.K)).all()
    assert (d2[:800] < quality.chi2_quantile(quality.CUTOFF, quality.K)).mean() > 0.99

    def concentrated(center, inv):
        for _ in range(50):
            d = z - center
            near = np.argsort(np.einsum("ij,jk,ik->i", d, inv, d), kind="stable")[:int(np.ceil(len(z) * quality.COVERAGE))]
            center = z[near].mean(axis=0)
            cov = np.cov(z[near].T, bias=True) + np.diag(np.square(quality.FLOORS))
            inv = np.linalg.inv(cov)
        return np.linalg.slogdet(cov)[1], center, cov

    best = min((concentrated(z[s].mean(axis=0), np.linalg.inv(np.cov(z[s].T, bias=True) + np.eye(quality.K)))
                for s in (rng.choice(1000, 12, replace=False) for _ in range(60))), key=lambda x: x[0])
    cov = (best[2] - np.diag(np.square(quality.FLOORS))) * quality.consistency(quality.COVERAGE, quality.K)
    d = z - best[1]
    inside = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov + np.diag(np.square(quality.FLOORS))), d) <= quality.chi2_quantile(0.975, quality.K)
    assert np.abs(z[inside].mean(axis=0) - np.array(got.center)).max() < 0.2


def test_edge_cases(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, words, None, None), (3, words, None, None), (None, "x " * 100, "en", "s"),
            (4, "#" * 50_000, "en", "s")] + [(10 + i, " ".join(f"w{j * (i + 3)}" for j in range(50 + i)), "en", "t") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr(
        "doc_id", "text", "lang", "source", "1 as n_words", "'x' as grp", "2 as z")
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].base_failed and by[2].base_failed and by[None].base_failed and not by[1].kept and by[1].distance is None
    assert by[3].kept and by[10].kept
    assert quality.judge(docs.limit(0)).count() == 0
    few = quality.judge(docs.where("doc_id < 5"))
    assert {r.doc_id: r.kept for r in few.collect()}[3]
