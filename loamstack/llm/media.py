"""Media columns: text bytes stored as 8-bit samples; signature sniffing that corrects declared types and carves embedded media."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, small_batches

#: Fixed values of public formats: magic bytes and the type they announce.
SIGNATURES = [
    (b"RIFF", "riff"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"\xff\xd8\xff", "image/jpeg"),
    (b"BM", "image/bmp"), (b"%PDF-", "application/pdf"), (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b\x08", "application/gzip"),
    (b"OggS", "audio/ogg"), (b"fLaC", "audio/flac"), (b"MThd", "audio/midi"), (b".snd", "audio/basic"),
]
#: Marks that end a piece, located by the same automaton.
TRAILERS = [(b"%%EOF", "pdf end"), (b"PK\x05\x06", "zip end"), (b"\xff\xd9", "jpeg end")]
#: Types that repeat their magic within one piece; there, magics inside an accepted piece start nothing.
CHAINED = {"application/pdf", "application/zip", "audio/ogg"}
SAMPLE_RATE = 8000
BLOCK = 64


def pad(raw: bytes) -> bytes:
    """The bytes, with zeros up to a positive multiple of 64."""
    return raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def to_wav(payload: bytes) -> bytes:
    """A canonical RIFF/WAVE file: 8-bit unsigned PCM, one channel; a data chunk of odd length gets a pad byte."""
    odd = b"\0" * (len(payload) & 1)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + odd
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def wav_data(b: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(start, length of the samples, end of the file) of the RIFF/WAVE at `at`, or None where its chunks or lengths are wrong."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    p, fmt = at + 12, False
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, p)
        if p + 8 + n > end:
            return None
        fmt |= name == b"fmt " and n >= 16
        if name == b"data":
            return (p + 8, n, end) if fmt else None
        p += 8 + n + (n & 1)
    return None


Marks = dict[str, list[int]]


def _next(marks: Marks, kind: str, at: int) -> int | None:
    """The first mark of a kind from `at` on."""
    i = bisect_left(marks[kind], at)
    return marks[kind][i] if i < len(marks[kind]) else None


def _png(b: bytes, at: int, marks: Marks) -> int | None:
    p = at + 8
    first = True
    while p + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (first and (name, n) != (b"IHDR", 13)) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        first, p = False, p + 12 + n
        if name == b"IEND":
            return p
    return None


def _gif(b: bytes, at: int, marks: Marks) -> int | None:
    if len(b) < at + 13:
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int | None:
        while p < len(b):
            if not b[p]:
                return p + 1
            p += 1 + b[p]
        return None

    while p is not None and p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1
        if kind == 0x21:
            p = blocks(p + 2)
        elif kind == 0x2C and p + 10 <= len(b):
            p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int, marks: Marks) -> int | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF and 0xC0 <= b[p + 1] <= 0xFE:
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return None
        scan, p = b[p + 1] == 0xDA, p + 2 + n
        if scan:
            end = _next(marks, "jpeg end", p)
            return None if end is None else end + 2
    return None


def _bmp(b: bytes, at: int, marks: Marks) -> int | None:
    if len(b) < at + 26:
        return None
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    return at + size if zero == 0 and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= start <= size <= len(b) - at else None


def _pdf(b: bytes, at: int, marks: Marks) -> int | None:
    """To the last end mark before the next document: each update of a document appends one."""
    stop = _next(marks, "application/pdf", at + 1)
    i = bisect_left(marks["pdf end"], len(b) if stop is None else stop)
    end = marks["pdf end"][i - 1] if i else -1
    return end + 5 if end > at and b.find(b"startxref", at, end) >= 0 else None


def _zip(b: bytes, at: int, marks: Marks) -> int | None:
    end = _next(marks, "zip end", at)
    if end is None or end + 22 > len(b):
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note if at + start + size == end and end + 22 + note <= len(b) else None


def _gzip(b: bytes, at: int, marks: Marks) -> int | None:
    d = zlib.decompressobj(31)
    view, p = memoryview(b), at
    try:
        while p < len(b) and not d.eof:
            d.decompress(view[p : p + 65536])  # in pieces; what it unpacks to is not kept
            p += 65536
    except zlib.error:
        return None
    return min(p, len(b)) - len(d.unused_data) if d.eof else None


def _flac(b: bytes, at: int, marks: Marks) -> int | None:
    """Metadata blocks up to the last one, then a frame. The format states no length of the frames: a stream goes on to the end."""
    p, last, first = at + 4, False, True
    while not last:
        if p + 4 > len(b):
            return None
        last, kind, n = b[p] >= 128, b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")
        if (first and (kind, n) != (0, 34)) or (not first and kind == 0) or kind == 127:
            return None
        first, p = False, p + 4 + n
    return len(b) if b[p : p + 1] == b"\xff" and b[p + 1 : p + 2] in (b"\xf8", b"\xf9") else None


def _ogg(b: bytes, at: int, marks: Marks) -> int | None:
    """Whole pages that follow on each other. A stream that breaks off in a page gives the complement of that place: nothing begins before it."""
    p = at
    while b[p : p + 5] == b"OggS\0":
        table = p + 27 + b[p + 26] if p + 27 <= len(b) else len(b) + 1
        if table > len(b) or table + sum(b[p + 27 : table]) > len(b):
            return ~p
        p = table + sum(b[p + 27 : table])
    return p if p > at else None


def _midi(b: bytes, at: int, marks: Marks) -> int | None:
    if len(b) < at + 14 or struct.unpack_from(">I", b, at + 4)[0] != 6:
        return None
    p = at + 14
    for _ in range(struct.unpack_from(">H", b, at + 10)[0]):
        if b[p : p + 4] != b"MTrk" or p + 8 > len(b):
            return None
        p += 8 + struct.unpack_from(">I", b, p + 4)[0]
    return p if p <= len(b) else None


def _snd(b: bytes, at: int, marks: Marks) -> int | None:
    if len(b) < at + 24:
        return None
    start, n = struct.unpack_from(">II", b, at + 4)
    return at + start + n if start >= 24 and at + start + n <= len(b) else None


def _riff(b: bytes, at: int, marks: Marks) -> int | None:
    found = wav_data(b, at)
    return found[2] if found else None


VALIDATORS = {
    "riff": _riff, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/pdf": _pdf, "application/zip": _zip,
    "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac, "audio/midi": _midi, "audio/basic": _snd,
}


def automaton() -> ahocorasick.Automaton:
    """Aho-Corasick over all magic bytes and end marks, on text in which each character is a byte."""
    a = ahocorasick.Automaton()
    for magic, kind in [*SIGNATURES, *TRAILERS]:
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def sniff(b: bytes, a: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, type) of every piece of media whose structure and lengths hold; nested pieces are reported too. Formats that
    repeat their magic, one for each page or entry, give one piece."""
    marks: Marks = {kind: [] for _, kind in [*SIGNATURES, *TRAILERS]}
    hits = []
    for last, (n, kind) in a.iter(b.decode("latin-1")):
        marks[kind].append(last - n + 1)
        if kind in VALIDATORS:
            hits.append((last - n + 1, kind))
    found, done = [], dict.fromkeys(CHAINED, 0)
    for at, kind in hits:
        if at < done.get(kind, 0):
            continue
        end = VALIDATORS[kind](b, at, marks)
        if kind in CHAINED and end is not None:
            done[kind] = end if end >= 0 else ~end + 1
        if end is not None and end >= 0:
            found.append((at, end, "audio/wav" if kind == "riff" else kind))
    return sorted(found)


def store_as_samples(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, declared type and media: the text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a WAV of 8-bit samples.

    A null or empty text is 64 zeros. The declared type is the generic one; sniffing corrects it. Each row is by
    itself: repeated rows, null ids and extra columns change nothing.
    """
    src = small_batches(df).select(df[id_col], F.coalesce(df[text_col], F.lit("")).cast("binary"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            for lo in range(0, len(raw), 256):
                part = raw[lo : lo + 256]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, 256), pa.array([len(x) for x in part], pa.int64()), pa.array(["application/octet-stream"] * len(part)), pa.array([to_wav(pad(x)) for x in part], pa.binary())],
                    names=[id_col, "n_bytes", "declared", "media"],
                )

    return src.mapInArrow(giving_back(encode), f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_bytes long, declared string, media binary")


def inspect(df: DataFrame, id_col: str) -> DataFrame:
    """Read media back: corrected type, the samples' digests, features, and what is embedded.

    Expects store_as_samples' columns. The type is that of the piece that covers the whole value, else the declared
    one. `carved` lists type:start:end of media found inside. A value that is not a WAV has null payload columns.
    """
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(id_col, "n_bytes", "declared", "media")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for declared, media in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                media = media or b""
                pieces = sniff(media, a)
                whole = next((k for s, e, k in pieces if s == 0 and e == len(media)), declared)
                carved = ",".join(f"{k}:{s}:{e}" for s, e, k in pieces if (s, e) != (0, len(media)))
                at = wav_data(media) if whole == "audio/wav" else None
                if at:
                    payload = media[at[0] : at[0] + at[1]]
                    x = np.frombuffer(payload, np.uint8)
                    feature = f"{whole};pcm8;rate={SAMPLE_RATE};n={len(x)};sum={int(x.sum(dtype=np.int64))};max={int(x.max()) if len(x) else 0};cross={int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))};carved={carved}"
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), feature)
                else:
                    row = (None, None, None, f"{whole};carved={carved}")
                for col, v in zip(out, (*row, len(media), hashlib.sha256(media).hexdigest(), whole, carved), strict=True):
                    col.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "media_bytes", "media_sha256", "media_type", "carved"],
            )

    return src.mapInArrow(
        giving_back(decode),
        f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, media_bytes long, media_sha256 string, media_type string, carved string",
    )
