from __future__ import annotations

import base64
import hashlib

import public_tokenizers as P
import pytest
import regex
import tiktoken

from classcraft.llm import bpe
from classcraft.llm.common import table

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def merged(ranks, piece):
    """Plain byte-pair merging of one match."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_documents_against_plain_merging(spark, enc):
    ranks = enc._mergeable_ranks
    docs = table(spark, SF, "documents").where("length(text) < 3000")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.digests(bpe.encode_documents(docs, RANKS, P.PATTERN)).collect():
        ids = [i for m in regex.finditer(P.PATTERN, texts[r.doc_id]) for i in merged(ranks, m.group().encode())]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("text", ["a b  c\n\n d's 12 x!!  y 　z", "ab " * 5000, "x" * 300 + " y" * 300, "   \n" * 50 + "é \U0001f600 !",
                                  "a\x1c b\x85 c", "<|endoftext|> it's"])
def test_pieces_change_nothing(enc, text):
    for size in (1, 7, 64):
        assert "".join(bpe.pieces(text, size)) == text
        assert bpe.encode_text(enc, text, size).tolist() == enc.encode_ordinary(text)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "z" * 200_000), (4, "word " * 60_000), (None, "a"), (None, "a"), (5, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids", "2 as id", "3 as decoded")
    out = bpe.encode_documents(docs, RANKS, P.PATTERN)
    got = out.collect()
    assert len(got) == len(rows)
    assert sorted((bytes(r.decoded) for r in got)) == sorted(((t or "").encode() for _, t in rows))
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_ids(out, RANKS, P.PATTERN).collect()}
    assert back[4] == b"word " * 60_000 and back[1] == b""
    assert bpe.digests(bpe.encode_documents(docs.limit(0), RANKS, P.PATTERN)).count() == 0
