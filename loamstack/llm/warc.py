"""Legacy archives: ARC files of both header versions are parsed and converted to WARC records, with revisits for equal payloads."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bitmap, in_bitmap, materialise, small_batches

#: Bytes of payload after which an archive is closed and a new one begun.
ARCHIVE_BYTES = 4 << 20
#: Fixed value: the profile that the WARC standard gives for revisits of equal payloads.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The field names that the two versions of ARC declare.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_CRAWLED = "20240101000000"


def arc_file(version: str, records: list[tuple[str, bytes]]) -> bytes:
    """An uncompressed ARC file: a version block, then header line, content and newline for each (url, content)."""
    body = f"{version} 0 loamstack\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    desc = {"URL": "filedesc://loamstack.arc", "IP-address": "0.0.0.0", "Archive-date": _CRAWLED, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "loamstack.arc"}
    out = [" ".join({**desc, "Archive-length": str(len(body))}[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"]
    size = len(out[0])
    for url, content in records:
        line = {**desc, "URL": url, "IP-address": "127.0.0.1", "Content-type": "text/html", "Checksum": str(zlib.crc32(content)), "Offset": str(size), "Archive-length": str(len(content))}
        out.append(" ".join(line[f] for f in ARC_FIELDS[version]).encode() + b"\n" + content + b"\n")
        size += len(out[-1])
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of every record after the version block. The block's second line says how to read header
    lines; fields are taken from the right, so that a url with spaces keeps them. Declared lengths are trusted only as far
    as the data goes: a record that runs past the end raises ValueError."""
    at, fields, view = 0, ARC_FIELDS["1"], memoryview(data)
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("ARC header line without end")
        line = data[at:end].decode("utf-8", "replace")
        if not line.strip():
            at = end + 1
            continue
        first = at == 0 and line.startswith("filedesc://")
        length = int(line.rsplit(" ", 1)[1])
        if end + 1 + length > len(data):
            raise ValueError("ARC record runs past the end")
        content = bytes(view[end + 1 : end + 1 + length])
        at = end + 1 + length
        if first:
            version = content.split(None, 1)[0].decode()
            fields = ARC_FIELDS.get(version, content.split(b"\n")[1].decode().split())
            continue
        yield dict(zip(fields, line.rsplit(" ", len(fields) - 1), strict=True)), content


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its empty line, payload); a block without a head is all payload."""
    at = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (b"", block)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(fields: dict[str, str], block: bytes, key: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record from ARC fields: date from Archive-date, a name-based identifier, digests of block and payload.

    `key` names the record; with `refers_to` (another record's key) it becomes a revisit that keeps the HTTP head only.
    """
    head, payload = payload_of(block)
    d = fields["Archive-date"]
    kept = head if refers_to is not None else block
    urn = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'loamstack:' + k)}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {urn(key)}", f"WARC-Record-Key: {key}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", f"WARC-Target-URI: {fields['URL']}", f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(kept)}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Refers-To-Key: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(kept)}", "", ""]
    return "\r\n".join(lines).encode() + kept + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an archive of gzip members, one record in each."""
    at, view = 0, memoryview(data)
    while at < len(data):
        d, parts = zlib.decompressobj(31), []
        while not d.eof and at < len(data):  # in pieces, so that what follows a member is not copied each time
            parts.append(d.decompress(view[at : at + 16384]))
            at += 16384
        at = min(at, len(data)) - len(d.unused_data)
        record = b"".join(parts)
        end = record.index(b"\r\n\r\n")
        lines = record[:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield fields, record[end + 4 : end + 4 + int(fields["Content-Length"])]


def convert_to_warc(df: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """Archives (one binary column) with a record for each row, written to the shared folder.

    Each row becomes a record of an ARC file (version 1 and 2 in turn), which is parsed and converted. Rows with equal
    payloads: that with the largest id is a response, the others revisit it; rows that share that largest id are all
    responses. A null body is empty, a null url is empty, a null id counts as smaller than any and is kept null.
    """
    src = small_batches(df).select(df[id_col].cast("long").alias("id"), F.coalesce(df[url_col], F.lit("")).alias("url"), F.coalesce(df[body_col], F.lit("")).cast("binary").alias("body"))
    src = src.withColumn("digest", F.sha1("body"))
    same = src.groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "last")
    same = materialise(same, "equal-payloads")
    maybe, alone = in_bitmap(src, "digest", id_bitmap(same, "d"))  # only rows that may have equals are shuffled
    maybe = maybe.join(same, F.col("digest") == F.col("d"), "left").withColumn("to", F.when(~F.col("last").eqNullSafe(F.col("id")), F.col("last")))
    rows = maybe.select("id", "url", "body", "to").unionByName(alone.select("id", "url", "body", F.lit(None).cast("long").alias("to")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list, version: str) -> pa.RecordBatch:
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
            arc = arc_file(version, [(url.replace("\r", "").replace("\n", "") or "-", head + body) for _, url, body, _ in rows])
            out = []
            for (fields, block), (key, _, _, to) in zip(parse_arc(arc), rows, strict=True):
                d = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.append(d.compress(warc_record(fields, block, "" if key is None else str(key), None if to is None else str(to))) + d.flush())
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])

        kept, size, n = [], 0, 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                kept.append(row)
                size += len(row[2])
                if size >= ARCHIVE_BYTES:
                    yield close(kept, "12"[n % 2])
                    kept, size, n = [], 0, n + 1
        if kept:
            yield close(kept, "12"[n % 2])

    return materialise(rows.mapInArrow(write, "archive binary"), "warc")


def read_warc(archives: DataFrame) -> DataFrame:
    """Records of the archives: id, payload_bytes, payload_digest, record_type, refers_to, url, date. Responses are checked
    against their digests; a mismatch raises ValueError."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                for f, block in parse_warc(data):
                    n, digest = int(f["WARC-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "response":
                        payload = payload_of(block)[1]
                        if (len(payload), digest_of(payload)) != (n, digest):
                            raise ValueError(f"record {f['WARC-Record-ID']} differs from its digest")
                    to = f.get("WARC-Refers-To-Key")
                    rows.append((int(f["WARC-Record-Key"]) if f["WARC-Record-Key"] else None, n, digest, f["WARC-Type"], int(to) if to else None, f["WARC-Target-URI"], f["WARC-Date"]))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date"])

    return archives.mapInArrow(read, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string")
