"""WARC archives: a deduplicating writer and a salvage reader.

Writing. Each record is a gzip member of its own. Members go through Spark's text sink, whose line separator is
set to the byte that ends every member (the high byte of its length; a member of 16 MiB and more is followed by
an empty member, whose last byte is 0 too), so archives are written by executors to any file system that Spark
can write, and concatenated members stay valid WARC.gz files. Among records with equal payloads of at least
``min_bytes``, the one with the largest id is the response; the others are revisits that refer to it and hold no
payload, only the digest and the HTTP length.

Reading. Archives come as binary files. A member (or, in a plain archive, a record at a version line) is checked:
gzip checksum, header syntax, declared block length, payload digest. After a failed check the reader searches
onward for the next member that unpacks to a version line, or the next version line, goes on from there and logs
the bytes in between as a quarantined gap with the reason. A member that holds several records is searched in its
unpacked bytes: its valid records come, and a gap with the member's offsets tells of the rest. Of a member that is cut off
or has a bad checksum, the records before the break come, except one that ends with the last byte that can be read.

Defined results: a null payload is empty; null ids are written as such, and a group of equal payloads without any
id is all responses; rows that share the largest id of their group are all responses; urls are percent-escaped;
an empty table writes and reads nothing; other columns of ``pages`` play no part. An archive begins with a warcinfo record
and holds at most ``RECORDS`` rows and ``ARCHIVE_BYTES`` (or one larger record); a reader holds one archive in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.llm.common import new_path, small_batches, utf8, values

MIN_BYTES = 1000
#: Rows and bytes (before the last record, compressed) of an archive; bytes in which a record's header has to end.
RECORDS, ARCHIVE_BYTES, HEADER_BYTES = 2000, 32 << 20, 1 << 20
_URN = "urn:x-row:"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


def record(row_id, url: str, payload: bytes, sha1: str, kind: str, refers, level: int = 4) -> bytes:
    """One record as gzip members, without its last byte, which is 0."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_URN}{'null' if row_id is None else row_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers}>"]
    return _packed(head, block, level)


def info(level: int = 4) -> bytes:
    """The record that an archive begins with, in the form of :func:`record`."""
    block = b"software: rowlens\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:x-info:0>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return _packed(head, block, level)


def _packed(head: list[str], block: bytes, level: int) -> bytes:
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(whole) + packer.flush()
    out = out if out[-1] == 0 else out + _EMPTY
    return out[:-1]


def write_archives(pages: DataFrame, path: str, id_col="page_id", url_col="url", payload_col="html", min_bytes=MIN_BYTES, records=RECORDS, size=ARCHIVE_BYTES) -> None:
    """Write ``pages`` as archives of gzip members below ``path``, in a folder for each of a task's archives in turn.

    Only digests are grouped; the table of repeated digests then meets the pages in a join whose hot digests
    adaptive execution splits (or which it broadcasts, when small)."""
    small_batches(pages.sparkSession, 128)
    body = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"), F.sha1(body).alias("sha1"))
    large = F.octet_length("payload") >= min_bytes
    keys = pages.select(F.col(id_col).alias("id"), F.octet_length(body).alias("n"), F.sha1(body).alias("key")).where(F.col("n") >= min_bytes)
    winners = keys.groupBy("key").agg(F.max("id").alias("top"), F.count("*").alias("copies")).where((F.col("copies") > 1) & F.col("top").isNotNull()).drop("copies")
    rows = rows.join(winners, large & (F.col("sha1") == F.col("key")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, n, held = -1, records, 0
        for b in batches:
            ids, urls, payloads, sha1, tops = values(b, "id"), values(b, "url"), utf8(b, "payload"), values(b, "sha1"), values(b, "top")
            out = []
            for i, u, p, s, t in zip(ids, urls, payloads, sha1, tops, strict=True):
                member = record(i, u, p, s, "response" if t is None or i == t else "revisit", t)
                if n >= records or held + len(member) > size and n:
                    archive, n, held = archive + 1, 0, 0
                    out.append((info(), archive))
                n, held = n + 1, held + len(member)
                out.append((member, archive))
            if out:
                members, archives = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(archives, pa.int32())], ["member", "archive"])

    members = rows.select("id", "url", "payload", "sha1", "top").mapInArrow(run, "member binary, archive int")
    members.select(F.col("member").cast("string").alias("value"), "archive").write.partitionBy("archive").option("compression", "none").option("lineSep", "\x00").text(path)


class Bad(ValueError):
    pass


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The readable content of the gzip member at an offset, the offset after it (or of the break) and why it breaks."""
    unpack, view, out = zlib.decompressobj(31), memoryview(data), []
    while not unpack.eof and at < len(data):
        part, saved = view[at : at + (1 << 14)], unpack.copy()
        try:
            out.append(unpack.decompress(part))
        except zlib.error as e:
            for i in range(len(part)):
                try:
                    out.append(saved.decompress(part[i : i + 1]))
                except zlib.error:
                    return b"".join(out), at + i, f"gzip: {str(e)[:60]}"
        at += len(part)
    if not unpack.eof:
        return b"".join(out), at, "gzip: member is cut off"
    return b"".join(out), at - len(unpack.unused_data), ""


def _records(inner: bytes, broken: str) -> tuple[list[dict], str]:
    """The valid records of a member's content and the first reason why others are not; of a broken member the record
    that ends with what can be read is not valid."""
    out, p, why = [], 0, ""
    while 0 <= p < len(inner):
        try:
            head, block, stop = _parse(inner, p)
            if broken and stop >= len(inner):
                raise Bad(broken)
            out.append(_checked(head, block))
            p = stop
        except Bad as e:
            why = why or str(e)
            p = inner.find(_VERSION, p + 1)
    return out, why


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """The header, block and end of the record at an offset of unpacked bytes, checked."""
    if not data.startswith(_VERSION, at):
        raise Bad("no version line")
    stop = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if stop < 0:
        raise Bad("header without end")
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("malformed header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit() or "warc-type" not in head or "warc-record-id" not in head:
        raise Bad("mandatory header field is missing")
    start, end = stop + 4, stop + 4 + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("block length does not match")
    return head, data[start:end], end + 4


def _checked(head: dict, block: bytes) -> dict:
    """The record's fields; its payload is checked against the digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    said = head.get("warc-payload-digest", "")
    sha1 = ""
    if said.startswith("sha1:"):
        try:
            sha1 = base64.b32decode(said[5:]).hex()
        except ValueError:
            raise Bad("malformed digest") from None
    kind, size = head["warc-type"], len(payload)
    if kind == "response" and sha1 and hashlib.sha1(payload).hexdigest() != sha1:
        raise Bad("payload digest does not match")
    if kind == "revisit":
        n = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(n[1]) if n else 0
    ident = lambda name: int(m[1]) if (m := re.search(rf"<{_URN}(-?\d+)>", head.get(name, ""))) else None
    return {"kind": kind, "id": ident("warc-record-id"), "refers_to": ident("warc-refers-to"), "uri": head.get("warc-target-uri", ""), "sha1": sha1, "n": size, "payload": payload if kind == "response" else None}


class _Next:
    """The next place where a member or record may begin; each byte is searched once, however many checks fail."""

    def __init__(self, data: bytes):
        self.data, self.found = data, {_MAGIC: -1, _VERSION: -1}

    def __call__(self, what: bytes, at: int) -> int:
        if self.found[what] < at:
            p = self.data.find(what, at)
            self.found[what] = p if p >= 0 else len(self.data)
        return self.found[what]


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(start, end, record or None, reason) of an archive's records and quarantined gaps, in order and without holes."""
    at, gap, why, onward = 0, -1, "", _Next(data)
    while at < len(data):
        out, end, broken, bad = [], at, "", ""
        try:
            if data.startswith(_MAGIC, at):
                inner, end, broken = _member(data, at)
                out, bad = _records(inner, broken)
                if not out and (broken or bad):
                    raise Bad(broken or bad)
            else:
                head, block, end = _parse(data, at)
                out.append(_checked(head, block))
        except Bad as e:
            if gap < 0:
                gap, why = at, str(e)
            at = min(onward(_MAGIC, at + 1), onward(_VERSION, at + 1))
            continue
        if gap >= 0:
            yield gap, at, None, why
            gap = -1
        for r in out:
            yield at, end, r, ""
        if broken:
            gap, why = at, broken
            at = min(onward(_MAGIC, at + 1), onward(_VERSION, max(end, at + 1)))
            continue
        if bad:
            yield at, end, None, bad
        at = end
    if gap >= 0:
        yield gap, len(data), None, why


SCHEMA = "archive string, start long, stop long, gap_reason string, record_type string, id long, refers_to long, uri string, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record, and for each quarantined gap (``gap_reason`` not null, record columns null)."""
    small_batches(spark, 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(values(b, "path"), values(b, "content"), strict=True):
                rows, held = [], 0
                for s, e, r, why in salvage(data):
                    body = r["payload"] if r and with_payload else None
                    rows.append((path, s, e, None, r["kind"], r["id"], r["refers_to"], r["uri"], r["n"], r["sha1"], body) if r else (path, s, e, why, *[None] * 7))
                    held += len(body or b"") + 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """Write the archives of ``pages``, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col)
    back = read_archives(spark, path, with_payload=False).where("gap_reason is null and record_type <> 'warcinfo'")
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
