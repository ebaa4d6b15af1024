"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are cut only at safe boundaries, a character that is no white space before a space or a line
feed: no match of the pre-splitting pattern spans such a place, and none looks back over it, so the
ids of the pieces joined are the ids of the whole text, and a text of any length is encoded in
pieces of bounded size.

The rank file is read on the driver (well under 1 MB for 50,000 tokens; a file over `MAX_RANK_BYTES`
is refused) and sent to the workers as part of the task.

Edge cases: a null text counts as empty and gives no ids and empty bytes; a text without a safe
boundary is encoded whole; repeated rows give repeated results; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 1 << 16
MAX_RANK_BYTES = 16 << 20
# Before the cut a letter, digit or punctuation mark; after it white space that starts a new match.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut at the first safe boundary after every ``size`` characters."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:] if start else text


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_BYTES + 1)
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"rank file over {MAX_RANK_BYTES} bytes")
    return raw


_ENCODINGS: dict = {}


def encoding(raw: bytes, pattern: str):
    """The tiktoken encoding of a rank file, kept per worker."""
    import tiktoken

    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def encode_text(enc, text: str | None, size: int = PIECE_CHARS) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint32)
    parts = [np.array(enc.encode_ordinary(piece), np.uint32) for piece in pieces(text, size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     decode: bool = True) -> DataFrame:
    """(id, ids array<int>, decoded binary): the ids of every whole text and, with ``decode``, the bytes they stand for."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(raw.value, pattern)
        for batch in batches:
            at, texts = 0, batch.column(1)
            while at < batch.num_rows:
                ids, bytes_out, start, total = [], [], at, 0
                while at < batch.num_rows and total < 1 << 20:  # bounded output batches, whatever the texts' lengths
                    ids.append(encode_text(enc, texts[at].as_py()))
                    bytes_out.append(enc.decode_bytes(ids[-1].tolist()) if decode else None)
                    total += len(ids[-1])
                    at += 1
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, at - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                     pa.array(bytes_out, pa.binary())], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, decoded binary): the raw bytes of each list of ids; a null list counts as empty."""
    raw = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(raw.value, pattern)
        for batch in batches:
            out = [enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of `encode_documents`' result."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
