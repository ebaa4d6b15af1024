from __future__ import annotations

import zlib
from collections import Counter

from classcraft.llm import langid
from classcraft.llm.common import table
from classcraft.llm.queries import op2_langid

SF = "/root/testdata/sf0.001"


def brute_grams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    line = " " + " ".join(words) + " "
    if not words:
        return []
    out = [c for c in line if c != " "] + [line[i:i + 2] for i in range(len(line) - 1)]
    return out + [line[i:i + 3] for i in range(len(line) - 2) if line[i + 1] != " "]


def brute_code(gram):
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return code


def brute_rank(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], brute_code(x[0])))[:size]]


def test_whole_table_against_brute_force(spark):
    rows = table(spark, SF, "documents").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    counts = {}
    for r in rows:
        if not held[r.doc_id] and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    size = langid.PROFILE
    profile = {lang: {g: i for i, g in enumerate(brute_rank(c, size))} for lang, c in counts.items()}
    got = {r.doc_id: r for r in op2_langid(spark, SF).collect()}
    right = total = 0
    for r in rows:
        top = brute_rank(Counter(brute_grams(r.text)), size)
        distance = {lang: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(top)) for lang, p in profile.items()}
        best = min(distance, key=lambda x: (distance[x], x))
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].held_out == held[r.doc_id]
        assert abs(got[r.doc_id].score - (1 - distance[best] / (len(top) * size))) < 1e-12
        if held[r.doc_id]:
            total += 1
            right += r.lang == best
    assert right / total > 0.95


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "the cat the dog", "en"), (2, "der hund die katze", "de"), (3, None, "en"), (4, "12 !!", "en"),
                                  (5, "", None), (None, "the the the", None), (6, "漢字", None), (7, "der " * 50_000, None),
                                  (7, "der " * 50_000, None)], "doc_id long, text string, lang string").selectExpr(
        "doc_id", "text", "lang", "'x' as p", "'y' as lang_pred", "1 as score")
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[1][0] == got[None][0] == "en" and got[2][0] == got[7][0] == "de"
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[6][1] == 0.0 and got[6][0] in ("de", "en")
    kept = langid.recognised(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "7", "7", "None"]
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
