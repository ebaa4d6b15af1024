from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from classcraft.llm import phrase_index
from classcraft.llm.common import table
from classcraft.llm.queries import op11_phrase_index

SF = "/root/testdata/sf0.001"


def brute_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10, slack=5):
    """Rows of the report, (text, id) lists compared place by place."""
    wanted = {("" if i is None else str(i), tuple(brute_words(t))) for i, t in items}
    out = []
    for doc_id, text in docs:
        w = brute_words(text)
        hit, ids, near = set(), set(), set()
        for item, words in wanted:
            n = min(window, len(words))
            for s in range(len(words) - n + 1 if words else 0):
                gram = list(words[s:s + n])
                for a in range(len(w) - n + 1):
                    if w[a:a + n] == gram:
                        hit |= set(range(a, a + n))
                        ids.add(item)
                if any(set(gram) <= set(w[a:a + n + slack]) for a in range(len(w))):
                    near.add(item)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=repr)


def report(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in phrase_index.contamination(d, i, **more).collect()), key=repr)


@pytest.mark.parametrize("letters, window", [(2, 3), (4, 4), (30, 10)])
def test_random_texts(spark, letters, window):
    rng = random.Random(letters)
    some = lambda n: [chr(97 + rng.randrange(min(letters, 26))) * rng.randrange(1, 3) for _ in range(n)]
    items = [(i, some(rng.randrange(1, 25))) for i in range(8)]
    docs = []
    for k in range(40):
        body = some(rng.randrange(0, 60))
        if k % 3 == 0:
            words = rng.choice(items)[1]
            at = rng.randrange(len(body) + 1)
            body[at:at] = words[rng.randrange(len(words)):] if k % 2 else [x for w in words for x in ([w] if rng.random() < 0.8 else [w, "zz"])]
        docs.append((k, ", ".join(body)))
    items = [(i, " ".join(w)) for i, w in items]
    assert report(spark, docs, items, window=window, slack=2) == brute(docs, items, window, 2)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs = [(k, f"start {k} the quick brown fox jumps over a lazy dog and runs far away home" if k % 4 else f"other {k} words") for k in range(30)]
    items = [(1, "The quick brown fox jumps over a lazy dog and runs"), (2, "words"), (3, "quick the")]
    want = brute(docs, items)
    assert report(spark, docs, items) == want
    monkeypatch.setattr(phrase_index, "BROADCAST_BYTES", -1)
    assert report(spark, docs, items) == want


def test_edge_cases(spark):
    line = " ".join(f"w{i}" for i in range(14))
    docs = [(1, None), (2, ""), (3, "... --"), (None, line), (5, line), (5, line), (5, line.upper()), (6, "É é " + line + " é"), (7, "w0 w1"), (8, "x " * 5000 + line),
            (9, " ".join([line] * 40)), (10, "\x00w0!w1?w2")]
    items = [(1, line), (1, line), (2, "é"), (None, "w0 w1"), (3, None), (4, ""), (5, "not there at all"), (11, line[:20])]
    assert report(spark, docs, items) == brute(docs, items)
    assert report(spark, docs, []) == brute(docs, [])
    assert report(spark, [], items) == []
    assert report(spark, [(1, None), (2, "...")], items) == brute([(1, None), (2, "...")], items)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 4, 5)], "doc_id long, text string, term string, doc int, pos int")
    items = spark.createDataFrame([(1, "b c", "y", 7)], "item_id long, text string, words string, item int")
    row = phrase_index.contamination(docs, items).first()
    assert (row.n_words, row.n_hit, row.n_items, row.n_near) == (3, 2, 1, 1)


def test_stretches_and_order(spark):
    """Overlapping windows make one stretch; spans are document positions."""
    docs = spark.createDataFrame([(7, "z z a b c d e z a b c"), (8, "c b a")], "doc_id long, text string")
    items = phrase_index.numbered_items(spark.createDataFrame([(1, "a b c d e")], "item_id long, text string"))
    exact, near = phrase_index.search(spark, phrase_index.build(docs), items, window=3, slack=0)
    assert sorted((r.item_id, r.first, r.last) for r in exact.collect()) == [("1", 2, 6), ("1", 8, 10)]
    assert near.count() == 2


def test_plan_has_no_python(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    plan = phrase_index.contamination(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_query_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = op11_phrase_index(spark, SF)
    want = con.execute(phrase_index.ORACLE_SQL).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert rows == sorted(tuple(r) for r in want.itertuples(index=False))
    assert got.where(F.col("contaminated")).count() > 0
