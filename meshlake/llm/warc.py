"""WARC 1.1 archives: a writer with revisit records and a salvaging reader.

The reader takes records one after another. Where a check fails (version line,
headers, length, the blank lines after the block, the gzip member, the digest of a
payload), it searches for the next gzip member that opens or the next version line
that has valid headers, goes on there, and logs the bytes between as a quarantined
gap (start, end, reason). Later records are not lost with a damaged one.

Archives are gzip members, one a record. A task rolls to a new file at ``roll_bytes``
and reports its files; the list is written once to the shared folder, so files of
lost or repeated tasks are never read. A file's name is new for each attempt.

Defined results: a null html is an empty payload. Of records with equal payloads the
one with the largest page_id is the response; repeated rows of that id are all
responses, and a null page_id counts as the least. An empty table gives an empty
result. Other columns of the input are not read. Payloads below ``min_revisit``
bytes are never revisits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
VERSION_LINE = re.compile(rb"\nWARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"


@dataclass(frozen=True)
class WarcParams:
    roll_bytes: int = 32 << 20  #: uncompressed bytes of an archive file, about
    min_revisit: int = 0
    level: int = 3  #: compression level
    broadcast_digests: int = 500_000  #: digests of several rows sent to every task at most, else a shuffled join
    read_tasks: int = 20_000  #: tasks that read archives at most


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_block(fields: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers alone, with the payload's length."""
    clean = re.sub(r"[\x00-\x20]+", "%20", url or "")
    http = b"HTTP/1.1 200 OK\r\n" + header_block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
    fields += [("WARC-Target-URI", clean)] if clean else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{'' if original is None else original}>")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + header_block(fields) + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(Exception):
    """A check failed."""


def parse_record(data: bytes, at: int = 0, check_digest: bool = True) -> tuple[dict, bytes, int]:
    """Headers (lower-case names), block and end of the record at ``at``."""
    if not VERSION.match(data, at):
        raise Damaged("no version line")
    # headers of any size, but not beyond the next version line
    after = VERSION_LINE.search(data, at + 1)
    stop = data.find(b"\r\n\r\n", at, after.start() + 1 if after else len(data))
    if stop < 0:
        raise Damaged("headers do not end")
    headers: dict[str, str] = {}
    for line in data[data.index(b"\n", at) + 1 : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or b"\n" in name:
            raise Damaged("bad header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in headers:
        raise Damaged("no length or type")
    start, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no end of record after the block")
    block = data[start:end]
    if check_digest and headers["warc-type"] == "response" and (want := headers.get("warc-payload-digest", "")).startswith("sha1:"):
        if payload_digest(http_payload(block)[1]) != want[5:]:
            raise Damaged("payload digest differs")
    return headers, block, end + 4


def http_payload(block: bytes) -> tuple[dict, bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for k, _, v in fields}, body


def open_member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content and end of the gzip member at ``at``; its checksum is checked."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof and pos < len(data):
            chunk = data[pos : pos + 65536]
            out.append(z.decompress(chunk))
            pos += len(chunk)
    except zlib.error as wrong:
        raise Damaged(f"gzip: {wrong}") from None
    if not z.eof:
        raise Damaged("gzip member is cut off")
    return b"".join(out), pos - len(z.unused_data)


def salvage(data: bytes):
    """Yield ("record", start, end, headers, block) and ("gap", start, end, reason, None) over an archive's bytes."""
    at, size, lost, why = 0, len(data), None, ""
    view = memoryview(data)
    while at < size:
        try:
            if data[at : at + 3] == MAGIC:
                content, end = open_member(view, at)
                found = list(salvage(content)) if not content.startswith(MAGIC) else [("gap", 0, 0, "nested member", None)]
                if not any(k == "record" for k, *_ in found):
                    raise Damaged(found[0][3] if found else "empty member")
                found = [(k, at, end, *rest) for k, _, _, *rest in found]
            else:
                headers, block, end = parse_record(data, at)
                found = [("record", at, end, headers, block)]
        except Damaged as wrong:
            if lost is None:
                lost, why = at, str(wrong)
            member, version = data.find(MAGIC, at + 1), VERSION.search(data, at + 1)
            at = min(member if member >= 0 else size, version.start() if version else size)
            continue
        if lost is not None:
            yield ("gap", lost, at, why, None)
            lost = None
        yield from found
        at = end
    if lost is not None:
        yield ("gap", lost, size, why, None)


def _filesystem(path: str):
    from pyarrow import fs

    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else f"file://{path}")


def write_archives(pages: DataFrame, p: WarcParams | None = None, folder: str | None = None) -> DataFrame:
    """Write (page_id, url, html) as archives below ``folder``; returns their list (path, bytes, records)."""
    p = p or WarcParams()
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload"))
    # digests that several rows have: a narrow table; no payload is shuffled for it
    several = rows.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("times")).where("times > 1")
    several = materialise(several.select(F.col("digest").alias("d"), "original"), "payloads")
    rows = rows.join(F.broadcast(several) if several.count() <= p.broadcast_digests else several, F.col("digest") == F.col("d"), "left")
    rows = rows.withColumn("revisit", (F.col("bytes") >= p.min_revisit) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")))
    # a revisit is written without its payload, so it does not travel further
    rows = rows.select("page_id", "url", F.when(F.col("revisit"), None).otherwise(F.col("payload")).alias("payload"), "bytes", "digest", "original", "revisit")

    def write(batches):
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        done, out, path, size, count = [], None, None, 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, size, count))
                out = None

        for b in batches:
            for page, url, payload, n, hexed, original, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "bytes", "digest", "original", "revisit")), strict=True):
                if out is None:
                    path, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                data = record(page, url, payload if not revisit else _Sized(n), digest, original, revisit)
                out.write(gzip_member(data, p.level))
                size, count = size + len(data), count + 1
                if size >= p.roll_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "bytes", "records"])

    return materialise(rows.mapInArrow(write, "path string, bytes long, records long"), "warc-list").withColumn("folder", F.lit(folder))


class _Sized(bytes):
    """Stands for a payload of which only the length is written."""

    def __new__(cls, n: int):
        self = super().__new__(cls)
        self.n = n
        return self

    def __len__(self) -> int:
        return self.n


def read_archives(archives: DataFrame, p: WarcParams | None = None) -> DataFrame:
    """Records and gaps of the listed archives.

    Columns: path, start, end, kind (record or gap), reason (of a gap), record_id,
    record_type, url, refers_to, payload_bytes, payload_digest, payload (of responses).
    """
    schema = "path string, start long, end long, kind string, reason string, record_id string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.binary()]

    def read(batches):
        for b in batches:
            for path, folder in zip(b.column("path").to_pylist(), b.column("folder").to_pylist(), strict=True):
                store, _ = _filesystem(folder)
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                rows, held = [], 0
                for kind, start, end, *rest in salvage(data):
                    if kind == "gap":
                        rows.append((path, start, end, kind, rest[0], None, None, None, None, None, None, None))
                    else:
                        h, (http, body) = rest[0], http_payload(rest[1])
                        revisit = h["warc-type"] == "revisit"
                        n = int(http["content-length"]) if revisit and http.get("content-length", "").isdigit() else len(body)
                        rows.append((path, start, end, kind, None, h.get("warc-record-id"), h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to"), n, h.get("warc-payload-digest", "").removeprefix("sha1:"), None if revisit else body))
                        held += len(body)
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("path", "folder").repartition(max(1, min(archives.count(), (p or WarcParams()).read_tasks))).mapInArrow(read, schema)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    records = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))).where("kind = 'record'")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return records.select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))
