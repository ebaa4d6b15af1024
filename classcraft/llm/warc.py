"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about `FRAME_BYTES`, and frames into bundles of about
`BUNDLE_BYTES`; a bundle ends with the seek table of the public seekable format (a skippable frame, so any
Zstandard tool reads the bundle as one stream). The index maps every record to its bundle, its frame and its place in the
unpacked frame: one record costs one frame.

Pages of equal payload (by SHA-1 and length) of at least `MIN_REVISIT` bytes are stored once: the largest page_id is the
response, the others are revisits that refer to it, without a payload but with its digest and length.

A task writes bundles and their index as one row, so a lost task's retry replaces both. Bundles are rows of a Parquet table in
the shared folder, which works on every store that Spark writes; `export_files` puts them into a folder as
`.warc.zst` files.

Edge cases: a null html is an empty payload; a null url has no target; null page_ids are smaller than all others, and
a group without any id is all responses; repeated rows of the largest page_id are all responses; an empty table gives no
bundle; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classcraft.llm.common import fresh_path

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 4 << 20
MIN_REVISIT = 1000
# Fixed values of the WARC and seekable Zstandard formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
_ENTRY = pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
BUNDLES = ("bundle string, content binary, records array<struct<record_id: string, page_id: bigint, frame: int, offset: bigint, "
           "length: bigint>>")


# ---------------------------------------------------------------- records

def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of the records of one or more unpacked frames."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        block = data[end + 4:end + 4 + size]
        head, _, payload = block.partition(b"\r\n\r\n")
        http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, http, payload
        at = end + 4 + size + 4


def page_of(identifier: str) -> int | None:
    name = identifier.removeprefix("<urn:x-page:").removesuffix(">")
    return None if name == "null" else int(name)


# ---------------------------------------------------------------- bundles

class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames, self.sizes, self.entries, self.frame, self.filled, self.packed = [], [], [], [], 0, 0

    def add(self, identifier: str, page_id: int | None, record: bytes) -> None:
        self.entries.append({"record_id": identifier, "page_id": page_id, "frame": len(self.frames), "offset": self.filled,
                             "length": len(record)})
        self.frame.append(record)
        self.filled += len(record)
        if self.filled >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.frame:
            self.frames.append(self.packer.compress(b"".join(self.frame)))
            self.sizes.append((len(self.frames[-1]), self.filled))
            self.packed += len(self.frames[-1])
            self.frame, self.filled = [], 0

    def finish(self) -> tuple[bytes, list[dict]]:
        self._close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table, self.entries


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, unpacked size) of every frame, from the footer."""
    count, descriptor, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC or descriptor & 0x7C:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    at, out = 0, []
    for i in range(count):
        where = len(content) - 9 - (count - i) * width
        packed, size = struct.unpack("<II", content[where:where + 8])
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(content: bytes, frame: int) -> bytes:
    start, packed, size = seek_table(content)[frame]
    return zstandard.ZstdDecompressor().decompress(content[start:start + packed], max_output_size=size)


def fetch(content: bytes, entry: dict) -> bytes:
    """One record by its index entry, unpacking only its frame."""
    return read_frame(content, entry["frame"])[entry["offset"]:entry["offset"] + entry["length"]]


def _pack(frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number, writer = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes)

        def row():
            content, entries = writer.finish()
            name = f"pages-{partition:06d}-{number:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([entries], pa.list_(_ENTRY))],
                                              names=["bundle", "content", "records"])

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i) for i in range(4))):
                page, url, refers = page.as_py(), url.as_py(), refers.as_py()
                writer.add(record_id(page), page, make_record(page, url, (html.as_py() or "").encode(), refers))
                if writer.packed >= bundle_bytes:
                    yield row()
                    number, writer = number + 1, BundleWriter(frame_bytes)
        if writer.entries:
            yield row()
    return run


def with_references(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): the page that stands for an equal payload, null for those that stand for themselves."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digests = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size"))
    large = digests.where(F.col("size") >= MIN_REVISIT)
    several = (large.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
               .where("n > 1 AND refers_to IS NOT NULL").select("digest", "size", "refers_to"))
    revisits = (large.join(several, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
                .select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "refers_to").distinct())
    match = F.col("page_id").eqNullSafe(F.col("of")) & (F.sha1(F.col("html").cast("binary")) == F.col("of_digest"))
    return rows.join(revisits, match, "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, path: str | None = None) -> str:
    """Write the bundles table; returns its path."""
    path = path or fresh_path(pages.sparkSession, "warc")
    bundles = with_references(pages).mapInArrow(_pack(FRAME_BYTES, BUNDLE_BYTES), BUNDLES)
    # a bundle is a large row: have the writer look at its size after each, not after a hundred
    (bundles.write.option("compression", "none").option("parquet.block.size", 32 << 20).option("parquet.block.size.row.check.min", 1)
     .option("parquet.block.size.row.check.max", 1).option("parquet.page.size.row.check.min", 1)
     .option("parquet.page.size.row.check.max", 1).parquet(path))
    return path


def open_archives(spark, path: str) -> DataFrame:
    return spark.read.schema(BUNDLES).parquet(path)


def index(spark, path: str) -> DataFrame:
    """(record_id, page_id, bundle, frame, offset, length) of every record."""
    return open_archives(spark, path).select("bundle", F.explode("records").alias("r")).select("r.record_id", "r.page_id", "bundle", "r.frame",
                                                                                               "r.offset", "r.length")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            content = content.as_py()
            for frame in range(len(seek_table(content))):
                out = []
                for fields, http, payload in read_records(read_frame(content, frame)):
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = len(payload) if kind == "response" else int(http["Content-Length"])
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                    refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    out.append((page_of(fields["WARC-Record-ID"]), size, digest, kind, refers))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()),
                     pa.array(cols[4], pa.int64())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read from the frames and checked."""
    return open_archives(spark, path).select("content").mapInArrow(
        _unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export_files(spark, path: str, folder: str) -> DataFrame:
    """Put the bundles into ``folder`` (a URI that executors reach through Arrow) as files; returns (file, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, f"{base}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([f"{base}/{name}"]), pa.array([len(content)], pa.int64())], names=["file", "bytes"])
    return open_archives(spark, path).select("bundle", "content").mapInArrow(run, "file string, bytes long")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
d AS (SELECT *, sha1(html) AS digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS last FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM w
"""
