import hashlib
import io

import pytest

from marginalia.llm import common, warc

SCHEMA = "page_id long, url string, html string, payload string, digest string"


def brute(rows):
    out, same = [], {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            same[p] = min(i, same.get(p, i))
    for i, _, h in rows:
        p = (h or "").encode()
        first = same.get(p)
        revisit = first is not None and i is not None and i > first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_pages(spark, sf):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, warc.query(spark, sf).collect()), key=str) == brute(rows)


def test_edges(spark, tmp_path):
    a, b = "é" * 50, "x" * 99
    rows = [(5, "http://a", a), (3, "http://b\r\nX: 1", a), (9, None, a), (None, "u", a), (1, "", b), (2, "", b), (4, "u", None), (6, "u", ""), (3, "again", a), (7, "u", "z" * 400_000), (8, "u", "z" * 400_000), (10, "u", "\r\n\r\n" * 40)]
    folder = f"file://{tmp_path}/warc"
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    back = warc.read_archives(warc.write_archives(warc.with_first(pages), folder), folder, payloads=True).collect()
    assert sorted((tuple(r)[:5] for r in back), key=str) == brute(rows)
    html = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
    assert all(r["payload"] == (b"" if r["record_type"] == "revisit" else html[r["payload_digest"]]) for r in back)
    none = warc.write_archives(warc.with_first(pages.limit(0)), folder)
    assert none.count() == 0 and warc.read_archives(none, folder).count() == 0


def test_records_stand_alone_and_need_the_dictionary(spark, tmp_path):
    import struct

    import zstandard

    folder = f"file://{tmp_path}/warc"
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html><body>page number {i}, and what is on all pages</body></html>" * 3, "", "") for i in range(400)], SCHEMA).coalesce(1)
    path = warc.write_archives(warc.with_first(pages).coalesce(1), folder).collect()[0]["path"]
    data = open(path, "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE and zstandard.ZstdCompressionDict(data[8 : 8 + size]).dict_id()
    frames, at = data[8 + size :], 0
    known = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    first = known.decompressobj()
    assert first.decompress(frames).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and first.unused_data
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(first.unused_data)
    assert len(list(warc.read_records(io.BytesIO(data)))) == 401
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_records(io.BytesIO(data[:-5])))


def test_revisits_refer_to_records(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    pages = spark.createDataFrame([(7, "http://b", "z" * 300, "", ""), (3, "http://a\nx", "z" * 300, "", ""), (9, "http://c", "z" * 300, "", "")], SCHEMA)
    heads = [h for r in warc.write_archives(warc.with_first(pages), folder).collect() for h, _ in warc.read_records(open(r["path"], "rb"))]
    response = next(h for h in heads if h["WARC-Type"] == "response")
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 2 and response["X-Page-ID"] == "3"
    for h in revisits:
        assert h["WARC-Refers-To"] == response["WARC-Record-ID"] and h["WARC-Refers-To-Target-URI"] == response["WARC-Target-URI"] == "http://a%0Ax"


def test_file_systems_by_the_schemes_of_hadoop(tmp_path):
    for uri in (f"file://{tmp_path}/a", f"file:{tmp_path}/a", f"{tmp_path}/a"):
        store, path = warc._file_system(uri)
        assert store.type_name == "local" and path == f"{tmp_path}/a"
    assert warc.SCHEMES["s3a"] == "s3"


def test_shared_dir_follows_the_session(spark):
    assert "marginalia/x-" in common.shared_dir(spark, "x")
