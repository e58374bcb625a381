"""Media columns typed by their content: magic bytes, validated structure, carved parts.

An Aho-Corasick automaton finds every magic number in one pass over a value. A format's validator then
walks its structure from there and gives the true length, or rejects the hit. A part that starts the
value and spans it corrects the declared type; other parts are carved out as embedded media.

Texts can be stored as 8-bit PCM sound and read back through the same sniffer.

Defined results: a null value is empty; a value without a valid part keeps its declared type; parts
inside an accepted part are not listed again; repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_rows

#: Media types and their magic bytes.
MAGIC = {
    "audio/wav": b"RIFF",
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/jpeg": b"\xff\xd8\xff",
    "image/gif": b"GIF8",
    "image/bmp": b"BM",
    "audio/ogg": b"OggS",
    "application/gzip": b"\x1f\x8b\x08",
    "application/pdf": b"%PDF-",
}
BLOCK = 64
RATE = 8000


class Part(NamedTuple):
    kind: str
    start: int
    length: int


def _riff(b: memoryview, at: int) -> tuple[str, int] | None:
    """RIFF: the chunks must fill the stated size exactly."""
    if at + 12 > len(b):
        return None
    size = struct.unpack_from("<I", b, at + 4)[0]
    form, end, pos, seen = bytes(b[at + 8 : at + 12]), at + 8 + size, at + 12, set()
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(form)
    if kind is None or end > len(b):
        return None
    while pos + 8 <= end:
        name, n = bytes(b[pos : pos + 4]), struct.unpack_from("<I", b, pos + 4)[0]
        seen.add(name)
        pos += 8 + n + n % 2
    if pos != end or (kind == "audio/wav" and not {b"fmt ", b"data"} <= seen):
        return None
    return kind, end - at


def _png(b: memoryview, at: int) -> tuple[str, int] | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or first != (name == b"IHDR"):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if name == b"IEND":
            return "image/png", pos - at
    return None


#: A marker within scan data that is not a stuffed byte, a fill byte or a restart.
SCAN_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")


def _jpeg(b: memoryview, at: int) -> tuple[str, int] | None:
    pos, scan = at + 2, False
    while pos + 2 <= len(b):
        if scan:
            found = SCAN_END.search(b, pos)
            if not found:
                return None
            pos = found.end() - 2
        mark = b[pos + 1]
        if b[pos] != 0xFF:
            return None
        if mark == 0xD9:
            return ("image/jpeg", pos + 2 - at) if scan else None
        if mark == 0xFF:
            pos += 1
            continue
        if mark == 0x00 or 0xD0 <= mark <= 0xD7 or pos + 4 > len(b):
            return None
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2:
            return None
        scan = scan or mark == 0xDA
        pos += 2 + n
    return None


def _gif(b: memoryview, at: int) -> tuple[str, int] | None:
    if bytes(b[at + 4 : at + 6]) not in (b"7a", b"9a") or at + 13 > len(b):
        return None

    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        return pos + 1

    pos, frames = at + 13 + table(b[at + 10]), 0
    while pos < len(b):
        if b[pos] == 0x3B:
            return ("image/gif", pos + 1 - at) if frames else None
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos, frames = blocks(pos + 11 + table(b[pos + 9])), frames + 1
        else:
            return None
    return None


def _bmp(b: memoryview, at: int) -> tuple[str, int] | None:
    if at + 54 > len(b):
        return None
    size, zero, data, header, wide, high, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or header < 40 or data < 14 + header:
        return None
    need = data + ((wide * depth + 31) // 32 * 4) * abs(high)
    return ("image/bmp", size) if wide > 0 and need <= size <= len(b) - at else None


def _ogg(b: memoryview, at: int) -> tuple[str, int] | None:
    """Pages until every stream that has begun has ended."""
    pos, begun, live = at, False, set()
    while pos + 27 <= len(b) and bytes(b[pos : pos + 4]) == b"OggS" and b[pos + 4] == 0:
        kind, serial, n = b[pos + 5], bytes(b[pos + 14 : pos + 18]), b[pos + 26]
        end = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if end > len(b) or (serial not in live and not kind & 2):
            return None
        begun = True
        live.add(serial)
        if kind & 4:
            live.discard(serial)
        pos = end
        if not live:
            return "audio/ogg", pos - at
    return None


def _gzip(b: memoryview, at: int) -> tuple[str, int] | None:
    work, pos = zlib.decompressobj(31), at
    try:
        while pos < len(b) and not work.eof:
            work.decompress(b[pos : pos + 65536], 1 << 16)
            while work.unconsumed_tail:
                work.decompress(work.unconsumed_tail, 1 << 16)
            pos += 65536
    except zlib.error:
        return None
    return ("application/gzip", min(pos, len(b)) - len(work.unused_data) - at) if work.eof else None


#: The end of a body: where its cross-reference table starts, and the end mark.
PDF_END = re.compile(rb"startxref\s{1,4}(\d{1,12})\s{1,4}%%EOF")
PDF_START = re.compile(rb"%PDF-\d")


def _pdf(b: memoryview, at: int) -> tuple[str, int] | None:
    """Up to the last end mark, before the next PDF, whose table lies within the part."""
    begin = PDF_START.match(b, at)
    if not begin:
        return None
    later = PDF_START.search(b, begin.end())
    last = None
    for end in PDF_END.finditer(b, begin.end(), later.start() if later else len(b)):
        if 0 <= int(end[1]) < end.start() - at:
            last = end
    return ("application/pdf", last.end() - at) if last else None


CHECK: dict[str, Callable[[memoryview, int], tuple[str, int] | None]] = dict(
    zip(MAGIC, (_riff, _png, _jpeg, _gif, _bmp, _ogg, _gzip, _pdf), strict=True)
)


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        made.add_word(magic.decode("latin-1"), (kind, len(magic)))
    made.make_automaton()
    return made


def sniff(value: bytes, finder: ahocorasick.Automaton) -> list[Part]:
    """Valid parts of a value, in order, without those inside an accepted part."""
    view, parts, free = memoryview(value), [], 0
    for last, (kind, n) in finder.iter(value.decode("latin-1")):
        start = last + 1 - n
        if start >= free and (found := CHECK[kind](view, start)):
            parts.append(Part(found[0], start, found[1]))
            free = start + found[1]
    return parts


def true_type(value: bytes, declared: str, parts: list[Part]) -> str:
    """The type of the part that is the whole value, or else the declared type."""
    return next((p.kind for p in parts if p.start == 0 and p.length == len(value)), declared)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; the payload's length must be even, as chunks are padded otherwise."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(value: bytes, part: Part) -> bytes:
    """The samples of a valid WAV part."""
    pos = part.start + 12
    while True:
        name, n = struct.unpack_from("<4sI", value, pos)
        if name == b"data":
            return value[pos + 8 : pos + 8 + n]
        pos += 8 + n + n % 2


def pad(text: bytes, block: int = BLOCK) -> bytes:
    return text + bytes(max(block, -(-len(text) // block) * block) - len(text))


def describe(samples: np.ndarray, kind: str) -> str:
    """A short text of whole-signal features."""
    total = np.bincount(samples, minlength=256)
    share = total[total > 0] / len(samples)
    entropy = float(-(share * np.log2(share)).sum())
    mean = float((total * np.arange(256)).sum()) / len(samples)
    turns = int(np.count_nonzero(np.diff((samples >= 128).astype(np.int8))))
    return f"{kind};rate={RATE};samples={len(samples)};mean={mean:.3f};entropy={entropy:.3f};crossings={turns}"


def _stored(text: str | None, finder: ahocorasick.Automaton) -> tuple[int, bytes, str, bytes]:
    """(bytes of the text, stored form, its type, payload read back)."""
    plain = (text or "").encode("utf-8", "replace")
    media = to_wav(pad(plain))
    parts = sniff(media, finder)
    kind = true_type(media, "application/octet-stream", parts)
    if kind != "audio/wav":
        raise ValueError("the stored form does not read back")
    return len(plain), media, kind, from_wav(media, parts[0])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, kind, payload): each text as sound, and the payload read back."""

    def make() -> Callable:
        finder = automaton()
        return lambda ids, texts: ((i, *_stored(t, finder)) for i, t in zip(ids, texts, strict=True))

    schema = "doc_id bigint, n_bytes bigint, media binary, kind string, payload binary"
    return map_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", "text"], schema, make)


def digests(docs: DataFrame) -> DataFrame:
    """The digests and features of each text's stored form, which is made and read back in one pass."""

    def make() -> Callable:
        finder = automaton()

        def rows(ids: list, texts: list) -> Iterator[tuple]:
            for i, text in zip(ids, texts, strict=True):
                n, m, k, p = _stored(text, finder)
                feature = describe(np.frombuffer(p, dtype=np.uint8), k)
                yield i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature

        return rows

    schema = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string"
    )
    return map_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", "text"], schema, make)


def sniff_column(df: DataFrame, key: str, value: str, declared: str) -> DataFrame:
    """(key, kind, start, length, part): one row for each valid part of a binary column, with the
    declared type corrected for values that are one part, and a row of the declared type where none is."""

    def make() -> Callable:
        finder = automaton()

        def rows(keys: list, values: list, kinds: list) -> Iterator[tuple]:
            for k, v, d in zip(keys, values, kinds, strict=True):
                v = bytes(v or b"")
                parts = sniff(v, finder)
                for p in parts or [Part(true_type(v, d, parts), 0, len(v))]:
                    yield k, p.kind, p.start, p.length, v[p.start : p.start + p.length]

        return rows

    return map_rows(
        df.select(F.col(key).cast("long").alias("key"), F.col(value).alias("value"), F.col(declared).alias("declared")),
        ["key", "value", "declared"],
        "key bigint, kind string, start bigint, length bigint, part binary",
        make,
    )
