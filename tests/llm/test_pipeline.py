from __future__ import annotations

import base64
import hashlib
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from classcraft.llm import langid, mixing
from classcraft.llm.common import table

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_langid import brute_grams, brute_rank  # noqa: E402
from test_simhash import brute_components, brute_fingerprint  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute_language(rows):
    size, counts = langid.PROFILE, {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"]:
            counts.setdefault(r["lang"], Counter()).update(brute_grams(r["text"]))
    profile = [set(brute_rank(c, size)) for c in counts.values()]
    return [r for r in rows if any(g in p for g in brute_rank(Counter(brute_grams(r["text"] or "")), size) for p in profile)]


def brute_simhash(rows):
    group = brute_components(sorted((r["doc_id"], brute_fingerprint(r["text"])) for r in rows))
    return [r for r in rows if group[r["doc_id"]] == r["doc_id"]]


def brute_suffix(rows, length=100):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        raw = r["text"].encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i:i + length] in seen:
                gone[i:i + length] = True
            seen.add(raw[i:i + length])
        text = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def brute_mix(rows):
    documents = pd.DataFrame(rows)  # noqa: F841  (read by name)
    taken = {i: t for i, _, _, _, t in duckdb.sql(mixing.ORACLE_SQL).fetchall()}
    words = {r["doc_id"]: len(r["text"].encode().split()) for r in rows}
    return [r for r in rows for _ in range(taken[r["doc_id"]] // words[r["doc_id"]] if words[r["doc_id"]] else 1)]


def key(rows):
    return sorted((r["doc_id"], r["text"], r["n_chars"], r["lang"], r["source"]) for r in rows)


def test_every_stage_and_the_run_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [r.asDict() for r in docs.collect()]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (brute_language, brute_simhash, brute_suffix, brute_mix)):
        docs = stage(spark, docs, SF).cache()
        rows = brute(rows)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert key([r.asDict() for r in docs.collect()]) == key(rows), name
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows:
        ids = enc.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_stages_on_an_empty_table_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0), (2, "a b", "en", None, 3), (2, "a b", "en", None, 3), (None, "1 2", "en", "s", 3)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()
