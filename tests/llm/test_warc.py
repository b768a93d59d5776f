"""Archives: exact round trips, and files that break the format."""

import base64
import gzip
import hashlib
import io

import pytest

from lumenrank.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x") for i, u, h in rows], "page_id long, url string, html string, sha string, payload string")


ROWS = [(5, "http://a/?q=ü", "<p>é\r\n\r\n</p>"), (3, "http://b", "<p>é\r\n\r\n</p>"), (9, None, None), (8, "http://c d\nX: y", ""), (1, "u", "x" * 700_000), (2, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello"), (3, "http://b", "<p>é\r\n\r\n</p>"), (None, "n", "<p>é\r\n\r\n</p>"), (None, "m", "alone")]


def test_round_trip(spark, tmp_path):
    listed = warc.write_archives(pages(spark, ROWS).repartition(3), f"file://{tmp_path}/w", archive_bytes=300)
    listed.write.parquet(f"{tmp_path}/m")
    manifest = spark.read.parquet(f"{tmp_path}/m")
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(ROWS) and manifest.count() > 3
    least = {}
    for i, _, h in ROWS:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        revisit = i is not None and i > least[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", least[h or ""] if revisit else None, None if revisit else b))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) or r.payload) for r in got), key=repr) == sorted(want, key=repr)


def test_members_are_gzip(tmp_path):
    two = warc.record(1, "u", b"abc", None) + warc.record(2, "u", b"abc", 1)
    assert gzip.decompress(two).count(b"WARC/1.1\r\n") == 2
    for size in (1, 7, 10**6):
        a, b = map(warc.parse, warc.members(io.BytesIO(two), size))
        assert a["payload"] == b"abc" and b["payload"] is None and b["refers_to"] == 1 and b["payload_digest"] == a["payload_digest"]


def test_broken_archives():
    good = warc.record(1, "u", b"abcdef", None)
    with pytest.raises(warc.FormatError):
        list(warc.members(io.BytesIO(good[:-3])))
    plain = gzip.decompress(good)
    for bad in (plain.replace(b"abcdef", b"abcdeg"), plain[:-1], plain + b"x", plain.replace(b"Content-Length: 6", b"Content-Length: 7")):
        with pytest.raises(warc.FormatError):
            warc.parse(bad)


def test_min_revisit_bytes_and_empty(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    got = {r.page_id: r.refers_to for r in warc.with_revisits(pages(spark, rows), 3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    listed = warc.write_archives(pages(spark, []), f"file://{tmp_path}/w")
    listed.write.parquet(f"{tmp_path}/m")
    assert warc.read_archives(spark.read.schema(listed.schema).parquet(f"{tmp_path}/m")).count() == 0


def foreign(kind, headers, block):
    """A record as other writers make it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


def test_foreign_archive(spark, tmp_path):
    """Records of all types, ids of other kinds, no digests or lengths but the one of the record, chunks left as they are."""
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nX: a\r\n b\r\n\r\n"
    chunks = b"3\r\nabc\r\n0\r\n\r\n"
    uuid = lambda n: ("WARC-Record-ID", f"<urn:uuid:00000000-0000-0000-0000-{n:012d}>")
    asked = ("Content-Type", "application/http; msgtype=request")
    got = ("Content-Type", "application/http;msgtype=response")
    md5 = hashlib.md5(chunks).hexdigest()
    records = [
        foreign("warcinfo", [uuid(1), ("Content-Type", "application/warc-fields")], b"software: x\r\n"),
        foreign("request", [uuid(2), asked, ("WARC-Target-URI", "http://a")], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        foreign("response", [uuid(3), got, ("WARC-Target-URI", "http://a")], http + chunks),
        foreign("response", [uuid(4), got, ("WARC-Payload-Digest", f"md5:{md5}"), ("WARC-Block-Digest", "blake3:00")], http + chunks),
        foreign("resource", [uuid(5), ("Content-Type", "text/plain")], b"plain\r\n\r\ntext"),
        foreign("metadata", [uuid(6)], b""),
        foreign("revisit", [uuid(7), got, ("WARC-Refers-To", "<urn:uuid:3>")], b"HTTP/1.1 200 OK\r\nA: b"),
    ]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(records))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/f.warc.gz", None)], "uri string, records long")
    rows = warc.read_archives(manifest).collect()
    assert [r.record_type for r in rows] == ["warcinfo", "request", "response", "response", "resource", "metadata", "revisit"]
    assert [r.payload and bytes(r.payload) for r in rows] == [b"software: x\r\n", b"", chunks, chunks, b"plain\r\n\r\ntext", b"", None]
    assert rows[2].payload_digest == warc.digest(chunks) and rows[3].payload_digest == md5
    assert all(r.page_id is None and r.refers_to is None and r.record_id.startswith("urn:uuid:") for r in rows)
    with pytest.raises(warc.FormatError):
        warc.parse(gzip.decompress(records[3]).replace(b"abc", b"abd"))
    for bad in (b"", b"WARC/1.0\r\n\r\n", b"WARC/1.0\r\nContent-Length: -1\r\n\r\n\r\n\r\n"):
        with pytest.raises(warc.FormatError):
            warc.parse(bad)


def test_an_archive_a_task(spark, tmp_path):
    listed = warc.write_archives(pages(spark, [(i, "u", f"text {i}") for i in range(22)]).coalesce(1), f"file://{tmp_path}/w", archive_bytes=1)
    listed.write.parquet(f"{tmp_path}/m")
    got = warc.read_archives(spark.read.parquet(f"{tmp_path}/m").coalesce(1))
    assert got.count() == 22 and got.select(warc.F.spark_partition_id()).distinct().count() > 10


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.op4_warc(spark, sf).collect()}
    assert got == {r.page_id: (len(r.html.encode()), warc.digest(r.html.encode())) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
