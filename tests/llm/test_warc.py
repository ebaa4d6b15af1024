from __future__ import annotations

import hashlib

import pytest
import zstandard

from classcraft.llm import warc
from classcraft.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(rows):
    last = {}
    for page, html in rows:
        if page is not None:
            last[html] = max(page, last.get(html, page))
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        to = last.get(html) if len(raw) >= 1000 and last.get(html) != page else None
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_round_trip(spark, monkeypatch, tmp_path, small):
    if small:
        monkeypatch.setattr(warc, "FRAME_BYTES", 5000)
        monkeypatch.setattr(warc, "BUNDLE_BYTES", 20_000)
    pages = table(spark, SF, "pages")
    again = pages.selectExpr("page_id + 1000000 as page_id", "url", "html").where("page_id % 3 = 0")
    extra = spark.createDataFrame([(None, None, None), (7_000_000, "http://x\r\ny/", "é" * 700), (None, "u", "é" * 700), (7_000_001, "v", ""),
                                   (7_000_002, "w", "WARC/1.1\r\n\r\n" * 200), (8, "dup", "z" * 999), (9, "dup", "z" * 999)],
                                  "page_id long, url string, html string")
    rows = pages.unionByName(again).unionByName(extra)
    path = warc.write_archives(rows.repartition(3))
    got = sorted((tuple(r) for r in warc.read_archives(spark, path).collect()), key=repr)
    assert got == brute([(r.page_id, r.html) for r in rows.collect()])
    bundles = {r.bundle: r for r in warc.open_archives(spark, path).collect()}
    if small:
        assert len(bundles) > 3
    for r in bundles.values():
        content = bytes(r.content)
        whole = b"".join(warc.read_frame(content, i) for i in range(len(warc.seek_table(content))))
        plain = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        assert plain == whole  # the seek table is skipped by any reader
        for entry in r.records:
            (fields, _, _), = warc.read_records(warc.fetch(content, entry.asDict()))
            assert fields["WARC-Record-ID"] == entry.record_id
    assert warc.index(spark, path).count() == rows.count()
    files = warc.export_files(spark, path, f"file://{tmp_path}/out").collect()
    assert {f.file.rsplit("/", 1)[1] for f in files} == set(bundles)
    assert all(open(f.file, "rb").read() == bytes(bundles[f.file.rsplit("/", 1)[1]].content) for f in files)


def test_edge_cases(spark):
    rows = [(1, None, "q" * 2000), (1, None, "q" * 2000), (0, "u", "q" * 2000), (None, None, "r" * 2000), (None, None, "r" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as refers_to", "2 as size")
    got = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in warc.read_archives(spark, warc.write_archives(pages)).collect())
    assert got == [(-1, "response", None), (-1, "response", None), (-1, "revisit", 1), (1, "response", None), (1, "response", None)]
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0
