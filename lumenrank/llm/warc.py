"""WARC archives: one gzip member a record, written per partition and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.common import materialise, shared_path, split_by_sketch

#: An archive is closed once it holds so many bytes; the reader's memory does not depend on it.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 256 << 10
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(uri: str | None) -> str:
    """A header value on one line."""
    return "".join(c if " " < c < "\x7f" else "%" + "%".join(f"{b:02X}" for b in c.encode("utf-8", "replace")) for c in uri or "about:blank")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit (refers_to given) with the headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(refers_url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


class FormatError(ValueError):
    """An archive that breaks the format."""


def members(source, size: int = READ_BYTES) -> Iterator[bytes]:
    """The content of each gzip member of a file-like source, inflated piece by piece. A truncated member is an error."""
    z, parts, rest = None, [], b""
    while True:
        data = rest or source.read(size)
        rest = b""
        if not data:
            break
        if z is None:
            z, parts = zlib.decompressobj(31), []
        parts.append(z.decompress(data))
        if z.eof:
            rest = z.unused_data
            yield b"".join(parts)
            z = None
    if z is not None:
        raise FormatError("the last member is cut off")


def _headers(data: bytes, at: int) -> tuple[str, dict[str, str], int]:
    """(first line, headers in lower case, where the block starts); a line that starts with white space goes on with the one before."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise FormatError("headers do not end")
    first, *lines = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode("utf-8", "replace")).split("\r\n")
    pairs = (x.partition(":") for x in lines)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}, end + 4


def _page(urn: str | None) -> int | None:
    """The number in a record id of ours; ids of other kinds have none."""
    s = (urn or "").strip("<>").removeprefix(_ID)
    return int(s) if re.fullmatch(r"-?[0-9]{1,18}", s) else None


def _check(what: str, said: str | None, data: bytes) -> None:
    """Compare data with a digest in a header, algorithm:value in base32 or hexadecimal; none and unknown algorithms say nothing."""
    name, _, value = (said or "").partition(":")
    if name.lower() in ("sha1", "sha256", "md5") and value:
        d = hashlib.new(name.lower(), data).digest()
        if value.upper().rstrip("=") not in (base64.b32encode(d).decode().rstrip("="), d.hex().upper()):
            raise FormatError(f"{what} digest")


def parse(data: bytes) -> dict:
    """One record of any type: framed by its content length, block and payload digests verified where it has them.

    The payload is what follows the HTTP headers of a block that has some, else the block; transfer codings are left as
    they are. payload is null for revisits, whose payload_bytes come from the HTTP headers (null without). payload_digest
    is the value in the header, for a payload without one its SHA-1. page_id and refers_to are null if ids are not ours.
    """
    first, head, at = _headers(data, 0)
    size = head.get("content-length", "")
    if not first.startswith("WARC/") or not size.isascii() or not size.isdigit():
        raise FormatError("not a record")
    n = int(size)
    block = data[at : at + n]
    if len(block) != n or data[at + n :] != b"\r\n\r\n":
        raise FormatError("the record is not as long as it says")
    _check("block", head.get("warc-block-digest"), block)
    kind, payload, said = head.get("warc-type", "").lower(), block, None
    if head.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        _, http, start = _headers(block if b"\r\n\r\n" in block else block + b"\r\n\r\n", 0)
        payload, said = block[start:], http.get("content-length")
    said = int(said) if said and said.isascii() and said.isdigit() else None
    full, payload_digest = kind != "revisit", head.get("warc-payload-digest")
    if full and "warc-segment-number" not in head and "warc-truncated" not in head:
        _check("payload", payload_digest, payload)
    return {
        "page_id": _page(head.get("warc-record-id")),
        "url": head.get("warc-target-uri"),
        "payload": payload if full else None,
        "payload_bytes": len(payload) if full else said,
        "payload_digest": payload_digest.partition(":")[2] if payload_digest else digest(payload) if full else None,
        "record_type": kind,
        "refers_to": _page(head.get("warc-refers-to")),
        "record_id": head.get("warc-record-id", "").strip("<>"),
    }


def read_archive(uri: str) -> Iterator[dict]:
    """The records of one archive in order; memory: one record."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None, buffer_size=READ_BYTES) as f:
        yield from map(parse, members(f))


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): payload is html in UTF-8, null as empty; refers_to is null for responses.

    Of equal payloads of min_revisit_bytes and more, rows with the least page_id are responses. Only digests and ids are
    aggregated; of the payloads those move whose digest a sketch does not rule out as repeated, the others are written
    where they are read. The join deals both sides by digest, so a hot payload can be split. Null ids are responses;
    other columns are not read; repeated rows each come back; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("len", F.octet_length("html").cast("long"))
    of = rows.where(F.col("len") >= min_revisit_bytes).groupBy("sha", "len").agg(F.min("page_id").alias("least"), F.max("page_id").alias("most")).where("least < most")
    of = materialise(of.select(F.concat("sha").alias("s"), (F.col("len") + 0).alias("n"), "least"), "warc-repeated")
    out = lambda df, refers: df.select("page_id", "url", F.col("html").cast("binary").alias("payload"), refers.alias("refers_to"))
    some, others = split_by_sketch(rows, F.xxhash64("sha"), of.select(F.xxhash64("s").alias("h")))
    both = some.join(of, (F.col("sha") == F.col("s")) & (F.col("len") == F.col("n")), "left")
    return out(both, F.when(F.col("page_id") > F.col("least"), F.col("least"))).unionAll(out(others, F.lit(None).cast("long")))


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row of pages (page_id, url, html) as a record; returns (uri, records, bytes) of the archives.

    Each task writes archives of its own under names that no other attempt uses; only those of the attempt that Spark
    keeps are in the manifest, so lost executors and repeated tasks leave no record twice. Null urls become about:blank, a null page_id an
    id without number; an empty table writes no archive. The manifest must be written or cached once: evaluating it anew writes anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, n, size, name = None, 0, 0, ""

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"uri": [posixpath.join(folder, name)], "records": [n], "bytes": [size]})

        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(posixpath.join(root, name), compression=None), 0, 0
                data = record(page_id, url, payload, refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return with_revisits(pages, min_revisit_bytes).mapInArrow(run, "uri string, records long, bytes long")


_RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"
#: Tasks that read, at most; each reads its archives one after another.
MAX_TASKS = 100_000


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that manifest (uri, records) lists, of any origin and all types, each archive read sequentially.

    records may be null; if given, a missing record is an error. payloads=False leaves payload null after it is verified.
    An empty manifest gives no rows. An archive has a task of its own: the number of tasks is given, so Spark doesn't fold
    the short list into one.
    """
    tasks = min(max(1, manifest.count()), MAX_TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split()[0] for x in _RECORD.split(",")]
        for b in batches:
            for uri, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held, size, seen = [], 0, 0
                for r in read_archive(uri):
                    seen += 1
                    if not payloads:
                        r["payload"] = None
                    size += len(r["payload"] or b"") + 200
                    held.append(r)
                    if size >= 8 << 20:
                        yield _batch(held, names)
                        held, size = [], 0
                if expected is not None and seen != expected:
                    raise FormatError(f"{uri} has {seen} records, not {expected}")
                if held:
                    yield _batch(held, names)

    return manifest.select("uri", F.col("records").cast("long")).repartition(tasks).mapInArrow(run, _RECORD)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    listed = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/archives")
    listed.write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(listed.schema).parquet(f"{folder}/manifest")
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
