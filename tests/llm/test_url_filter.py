from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from classcraft.llm import url_filter as u
from classcraft.llm.common import table
from classcraft.llm.queries import URL_RULES, op6_url_filter

SF = "/root/testdata/sf0.001"


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    stop = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:stop] if stop > end else ""


def brute_rule(host, path):
    fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def test_whole_table(spark):
    urls = {r.page_id: r.url for r in table(spark, SF, "pages").collect()}
    got = op6_url_filter(spark, SF).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path) == brute_parts(urls[r.page_id])
        rule, verdict = brute_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert {r.verdict for r in got if r.rule is None} <= {"allow", "block"}
    right = [(r.score > 0) == (r.verdict == "block") for r in got if r.rule is not None]
    assert sum(right) / len(right) > 0.9  # the method agrees with the rules it learned from


def test_split_and_rules(spark):
    cases = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/En/x?y#z", "x://h#f/a", "x://h?q/a", "a://b://c/d", "http://www.example.com/en/a",
             "http://example.com/en", "http://notexample.com/en/", "http://net/es/", "http://x.net/es", "http://com/", "http://com", "x://y\n.com/\nz"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, url string")
    host, path = u.split_url(F.col("url"))
    df = df.select("i", host.alias("h"), path.alias("p"))
    rule, verdict = u.rule_of(F.col("h"), F.col("p"), URL_RULES)
    for r in df.select("*", rule.alias("rule"), verdict.alias("verdict")).collect():
        assert (r.h, r.p) == brute_parts(cases[r.i])
        assert (r.rule, r.verdict) == brute_rule(r.h, r.p)


def test_viterbi_finds_the_best_split():
    shares = {"ab": -1.0, "abc": -1.5, "cab": -1.2, "c": -2.5, "b": -2.0, "a": -2.2}
    words = u.Segmenter(shares, 4.0)
    for name in ("abcab", "cabc", "zzab", "abababc", "xabcx"):
        def value(cuts):
            parts = [name[s:e] for s, e in zip((0, *cuts), (*cuts, len(name)))]
            return sum(shares.get(p, 1 - 4.0 - len(p)) for p in parts)
        best = max(value(c) for n in range(len(name)) for c in itertools.combinations(range(1, len(name)), n))
        got = words.split(name)
        assert "".join(got) == name and math.isclose(sum(shares.get(p, -3.0 - len(p)) for p in got), best)


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "nothing", "<p>word word</p>"), (None, "http://a.com/x", "x"), (3, "http://" + "a" * 5000 + ".org/q", ""),
            (3, "http://b.net/es/1", None), (3, "http://b.net/es/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as ruling", "1 as score")
    got = u.judge(pages, URL_RULES).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} <= {"allow", "block"}
    assert u.judge(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in u.judge(pages, []).collect()} == {"allow"}
