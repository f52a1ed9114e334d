"""A content-addressed archive of WARC records.

Payload bytes are stored once, under their SHA-256; each record's exact header
bytes are stored apart, with the digest of its payload. Reading joins the two:
the record is header + payload + two line ends, byte for byte as it was, and is
parsed and checked against both its digests before anything is derived from it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, released

DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-record")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(key))}>"


def header(kind: str, page_id: int | None, uid: int, url: str | None, sha1: str, n: int, first_page: int | None, first_uid: int, first_url: str | None) -> bytes:
    """The header block of a record, with the blank line that ends it."""
    clean = lambda s: "".join(c if c.isprintable() else "%" + c.encode("utf-8", "surrogatepass").hex() for c in s or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(f'{page_id}/{uid}')}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(f'{first_page}/{first_uid}')}", f"WARC-Refers-To-Target-URI: {clean(first_url)}", f"X-Refers-To-Page-ID: {'' if first_page is None else first_page}"]
    return ("\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {n}"]) + "\r\n\r\n").encode()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of one whole record; ValueError if it is malformed."""
    head, end, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not end or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length does not match its block")
    return fields, rest[:n]


@dataclass
class Archive:
    """headers: (page_id, sha256, n, header); payloads: (sha256, payload), one row per digest, payloads compressed."""

    headers: DataFrame
    payloads: DataFrame


def write(pages: DataFrame, min_revisit_bytes: int = 0) -> Archive:
    """Archive every row of (page_id, url, html); a null html is an empty payload.

    Of rows with equal payloads of at least ``min_revisit_bytes``, the one with
    the largest page id is the response (of repeated rows with that id, one),
    the others revisit it. A null page id is smaller than any other.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            raw = [(h or "").encode("utf-8", "surrogatepass") for h in b.column("html").to_pylist()]
            cols = [b.column("page_id"), b.column("url"), pa.array(range(at, at + len(raw)), pa.int64()), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw]), pa.array([len(x) for x in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "uid", "sha256", "sha1", "n"])
            at += len(raw)

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    base = materialize(rows.mapInArrow(released(digests), "page_id long, url string, uid long, sha256 binary, sha1 string, n long"), "warc-base")
    first = materialize(base.groupBy("sha256").agg(F.max(F.struct("page_id", "uid", "url")).alias("w")).select("sha256", "w.*").toDF("sha256", "first_page", "first_uid", "first_url"), "warc-first")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, url, uid, sha1, n, fp, fu, furl in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "uid", "sha1", "n", "first_page", "first_uid", "first_url"))):
                out.append(header("response" if n < min_revisit_bytes or uid == fu else "revisit", page, uid, url, sha1, n, fp, fu, furl))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("sha256"), b.column("n"), pa.array(out, pa.binary())], ["page_id", "sha256", "n", "header"])

    head = materialize(base.join(first, "sha256").mapInArrow(released(headers), "page_id long, sha256 binary, n long, header binary"), "warc-headers")

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        seen: set[bytes] = set()
        for b in batches:
            digest_and_payload = []
            for h in b.column("html").to_pylist():
                raw = (h or "").encode("utf-8", "surrogatepass")
                key = hashlib.sha256(raw).digest()
                if key not in seen:
                    # of a payload that comes again in this task, one copy leaves it
                    seen.add(key)
                    digest_and_payload.append((key, squeeze(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in digest_and_payload], pa.binary()) for i in (0, 1)], ["sha256", "payload"])

    stored = rows.select("html").mapInArrow(released(payloads), "sha256 binary, payload binary").groupBy("sha256").agg(F.first("payload").alias("payload"))
    out = Archive(head, materialize(stored, "warc-payloads"))
    drop_scratch(base)
    drop_scratch(first)
    return out


def read(archive: Archive, keep_record: bool = False) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to (and the record's bytes).

    Every record is rebuilt, parsed and verified; a payload that does not
    match the digest it is stored under, or its record's, fails the job.
    """
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", record binary" * keep_record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for key, head, payload in zip(*(b.column(c).to_pylist() for c in ("sha256", "header", "payload"))):
                record = head + expand(payload) + b"\r\n\r\n"
                fields, block = parse(record)
                sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()
                if hashlib.sha256(block).digest() != key or fields["WARC-Payload-Digest"] != f"sha1:{sha1}":
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                to = fields.get("X-Refers-To-Page-ID")
                out.append((int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, len(block), sha1, fields["WARC-Type"], int(to) if to else None, *([record] * keep_record)))
            cols = list(zip(*out)) if out else [()] * (5 + keep_record)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record"][: len(cols)])

    return archive.headers.join(archive.payloads, "sha256").select("sha256", "header", "payload").mapInArrow(released(run), kinds)


def standard(archive: Archive, compress: bool = True) -> DataFrame:
    """(page_id, record_type, record): every record as other tools read it, WARC/1.1.

    A response's block is an HTTP message with the payload as its body
    (``application/http; msgtype=response``); a revisit's is the same message's head
    alone, and the payload is that of the record it refers to. With ``compress`` each
    record is one gzip member, so that records put one after the other are a
    ``.warc.gz`` file. The payload digest is of the body in either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for page, n, head, payload in zip(*(b.column(c).to_pylist() for c in ("page_id", "n", "header", "payload"))):
                fields = head.decode().split("\r\n")[:-2]
                kind = fields[1].partition(": ")[2]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
                block = http + expand(payload) if kind == "response" else http
                block_digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                kept = [x for x in fields if not x.startswith(("Content-Type:", "Content-Length:"))]
                whole = "\r\n".join([*kept, f"WARC-Block-Digest: sha1:{block_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
                rows.append((page, kind, gzip.compress(whole, 6, mtime=0) if compress else whole))
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary()))], ["page_id", "record_type", "record"])

    return archive.headers.join(archive.payloads, "sha256").select("page_id", "n", "header", "payload").mapInArrow(released(run), "page_id long, record_type string, record binary")


def read_standard(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, payload) of the records in WARC bytes, compressed or not, one after the other; a revisit's payload is empty. ValueError if they are malformed."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(fields["Content-Length"])
        block = raw[end + 4 : end + 4 + n]
        at = end + 4 + n
        if len(block) != n or raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError("record length does not match its block")
        at += 4
        yield fields, block.partition(b"\r\n\r\n")[2]
