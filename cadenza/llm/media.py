"""Media columns: signature sniffing, validation, type correction and carving.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over
a binary value. At each hit the format's validator walks the structure (chunk
lengths, checksums, markers, terminators) and says how long the item is, or
that it is none. The item at offset 0 gives the true type, which corrects a
declared one; valid items further in are carved as embedded media. Hits inside
an item that was already confirmed at the same level are its own content and
are looked at only where the format is a container of arbitrary bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact, pieces, small_batches

#: Magic bytes, the format they begin, and how far into the item they stand.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "image/png", 0),
    (b"\xff\xd8\xff", "image/jpeg", 0),
    (b"GIF87a", "image/gif", 0),
    (b"GIF89a", "image/gif", 0),
    (b"BM", "image/bmp", 0),
    (b"WAVE", "audio/wav", 8),
    (b"WEBP", "image/webp", 8),
    (b"AVI ", "video/avi", 8),
    (b"fLaC", "audio/flac", 0),
    (b"OggS", "audio/ogg", 0),
    (b"ftyp", "video/mp4", 4),
    (b"%PDF-", "application/pdf", 0),
    (b"PK\x03\x04", "application/zip", 0),
    (b"\x1f\x8b\x08", "application/gzip", 0),
]

#: The payload's unit, and the rate that a stored sample table declares.
UNIT, RATE = 192, 8000
#: What a column of texts declares its values to be.
DECLARED = "text/plain"


def _png(d: bytes, at: int) -> int | None:
    p = at + 8
    while p + 12 <= len(d):
        n = int.from_bytes(d[p : p + 4], "big")
        kind = d[p + 4 : p + 8]
        if p + 12 + n > len(d) or zlib.crc32(d[p + 4 : p + 8 + n]) != int.from_bytes(d[p + 8 + n : p + 12 + n], "big") or (p == at + 8) != (kind == b"IHDR"):
            return None
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return None


def _jpeg(d: bytes, at: int) -> int | None:
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        marker = d[p + 1]
        if marker == 0xFF:
            p += 1
            continue
        n = int.from_bytes(d[p + 2 : p + 4], "big")
        if n < 2 or marker in (0, 0xD8, 0xD9):
            return None
        p += 2 + n
        if marker == 0xDA:  # entropy-coded data up to a marker that is neither stuffing nor a restart
            while True:
                p = d.find(b"\xff", p)
                if p < 0 or p + 1 >= len(d):
                    return None
                if d[p + 1] == 0xD9:
                    return p + 2 - at
                if d[p + 1] != 0 and not 0xD0 <= d[p + 1] <= 0xD7:
                    break
                p += 2
    return None


def _gif(d: bytes, at: int) -> int | None:
    if at + 13 > len(d):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    p = at + 13 + table(d[at + 10])
    while p < len(d):
        kind = d[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= len(d):
            p += 11 + table(d[p + 9])
        else:
            return None
        while p < len(d) and d[p]:
            p += d[p] + 1
        p += 1
    return None


def _bmp(d: bytes, at: int) -> int | None:
    if at + 30 > len(d):
        return None
    n, _, pixels, header = struct.unpack_from("<IIII", d, at + 2)
    planes, depth = struct.unpack_from("<HH", d, at + 26)
    good = header in (40, 52, 56, 108, 124) and 14 + header <= pixels < n <= len(d) - at and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return n if good else None


def _riff(d: bytes, at: int) -> int | None:
    if at < 0 or d[at : at + 4] != b"RIFF" or at + 12 > len(d):
        return None
    n = 8 + int.from_bytes(d[at + 4 : at + 8], "little")
    if at + n > len(d):
        return None
    p = at + 12
    while p + 8 <= at + n:
        size = int.from_bytes(d[p + 4 : p + 8], "little")
        p += 8 + size + (size & 1)
    return n if p == at + n else None


def _checksums(bits: int, polynomial: int) -> list[int]:
    table = []
    for byte in range(256):
        x = byte << bits - 8
        for _ in range(8):
            x = (x << 1 ^ polynomial if x >> bits - 1 else x << 1) & (1 << bits) - 1
        table.append(x)
    return table


_CRC8, _CRC16 = _checksums(8, 0x07), _checksums(16, 0x8005)


def _flac_header(d: bytes, p: int) -> bool:
    """Whether a frame's header, with its checksum, stands at a place."""
    if p + 6 > len(d) or d[p] != 0xFF or d[p + 1] & 0xFE != 0xF8 or d[p + 2] >> 4 == 0 or d[p + 2] & 15 == 15 or d[p + 3] & 1:
        return False
    lead = d[p + 4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    q = p + 5 + more + {6: 1, 7: 2}.get(d[p + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(d[p + 2] & 15, 0)
    if more < 0 or q >= len(d):
        return False
    crc = 0
    for byte in d[p:q]:
        crc = _CRC8[crc ^ byte]
    return crc == d[q]


def _flac(d: bytes, at: int) -> int | None:
    """Metadata blocks, then frames: each ends where its checksum holds and another frame begins, the last where none does."""
    p, last = at + 4, False
    while not last:
        if p + 4 > len(d) or (p == at + 4 and d[p] & 0x7F):
            return None
        last = bool(d[p] & 0x80)
        p += 4 + int.from_bytes(d[p + 1 : p + 4], "big")
    if p > len(d):
        return None
    while _flac_header(d, p):
        crc, ends = 0, -1
        for e in range(p, len(d)):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ d[e]]
            if crc == 0 and e >= p + 7:
                if e + 1 == len(d) or _flac_header(d, e + 1):
                    ends = e + 1
                    break
                ends = e + 1 if ends < 0 else ends
        if ends < 0:
            break
        p = ends
    return p - at


def _ogg(d: bytes, at: int) -> int | None:
    p = at
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d):
        segments = d[p + 26]
        n = 27 + segments + sum(d[p + 27 : p + 27 + segments])
        if d[p + 4] or p + n > len(d):
            return None
        p += n
        if d[p - n + 5] & 4:
            return p - at
    return p - at if p > at else None


def _mp4(d: bytes, at: int) -> int | None:
    """Boxes in a row; a size of 1 stands for one of 64 bits, a size of 0 for all that follows."""
    p, boxes = at, 0
    while at >= 0 and p + 8 <= len(d):
        n, least = int.from_bytes(d[p : p + 4], "big"), 8
        if n == 1:
            n, least = int.from_bytes(d[p + 8 : p + 16], "big"), 16
        elif n == 0 and boxes:
            n = len(d) - p
        kind = d[p + 4 : p + 8]
        if n < least or p + n > len(d) or not kind.isalnum() or (boxes == 0) != (kind == b"ftyp"):
            break
        p, boxes = p + n, boxes + 1
    return p - at if boxes >= 2 else None


class Trailers:
    """Where the trailers of a value stand, found once however many headers there are."""

    def __init__(self, data: bytes):
        self.data, self._at = data, {}

    def at(self, mark: bytes) -> list[int]:
        if mark not in self._at:
            self._at[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self._at[mark]

    def last_before(self, mark: bytes, start: int, stop: int) -> int:
        """The last place of a mark within [start, stop), or -1."""
        places = self.at(mark)
        k = bisect_left(places, stop) - 1
        return places[k] if k >= 0 and places[k] >= start else -1

    def archives(self) -> dict[int, int]:
        """Beginning -> end of what each end-of-directory record of a ZIP file describes."""
        if None not in self._at:
            found, d = {}, self.data
            for p in reversed(self.at(b"PK\x05\x06")):
                if p + 22 <= len(d):
                    size, start = struct.unpack_from("<II", d, p + 12)
                    found[p - size - start] = p + 22 + struct.unpack_from("<H", d, p + 20)[0]
            self._at[None] = found
        return self._at[None]


def _pdf(d: bytes, at: int, trailers: Trailers) -> int | None:
    """Up to the last end mark before the next header; a cross-reference must stand before it."""
    if not d[at + 5 : at + 6].isdigit():
        return None
    heads = trailers.at(b"%PDF-")
    k = bisect_right(heads, at)
    end = trailers.last_before(b"%%EOF", at, heads[k] if k < len(heads) else len(d))
    return None if end < 0 or trailers.last_before(b"startxref", at, end) < 0 else end + 5 - at


def _zip(d: bytes, at: int, trailers: Trailers) -> int | None:
    end = trailers.archives().get(at)
    return end - at if end is not None and end <= len(d) else None


def _gzip(d: bytes, at: int) -> int | None:
    work, p = zlib.decompressobj(31), at
    try:
        while p < len(d) and not work.eof:
            work.decompress(work.unconsumed_tail or d[p : p + 65536], 1 << 20)
            if not work.unconsumed_tail:
                p += 65536
    except zlib.error:
        return None
    return min(p, len(d)) - len(work.unused_data) - at if work.eof else None


VALIDATORS = {
    "image/png": _png,
    "image/jpeg": _jpeg,
    "image/gif": _gif,
    "image/bmp": _bmp,
    "audio/wav": _riff,
    "image/webp": _riff,
    "video/avi": _riff,
    "audio/flac": _flac,
    "audio/ogg": _ogg,
    "video/mp4": _mp4,
    "application/pdf": _pdf,
    "application/zip": _zip,
    "application/gzip": _gzip,
}


#: Formats whose end is known by a trailer only.
WITH_TRAILERS = {"application/pdf", "application/zip"}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, kind, back in MAGIC:
        a.add_word(magic.decode("latin-1"), (kind, back, len(magic)))
    a.make_automaton()
    return a


def items(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every confirmed item, by offset, those within others included.

    An item is looked for inside another one only past the latter's header, and
    a hit that a validator already walked over as the same container's next
    page or frame is not reported again.
    """
    out: list[tuple[str, int, int]] = []
    done: dict[str, int] = {}
    trailers = Trailers(data)
    for end, (kind, back, size) in _automaton().iter(data.decode("latin-1")):
        at = end - size + 1 - back
        if at < 0 or at < done.get(kind, 0):
            continue
        check = VALIDATORS[kind]
        n = check(data, at, trailers) if kind in WITH_TRAILERS else check(data, at)
        if n:
            out.append((kind, at, n))
            if kind in ("audio/ogg", "application/pdf"):
                done[kind] = at + n
    return sorted(out, key=lambda x: (x[1], -x[2]))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """Bytes as unsigned 8-bit samples of one channel in a RIFF file; lossless, padded only in the container."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def wav_samples(d: bytes, at: int, n: int) -> bytes:
    """The data chunk of a confirmed RIFF item."""
    p = at + 12
    while p + 8 <= at + n:
        size = int.from_bytes(d[p + 4 : p + 8], "little")
        if d[p : p + 4] == b"data":
            return d[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    return b""


def feature(samples: bytes, embedded: int) -> str:
    """Level, crossings of the middle and entropy of 8-bit samples, and how many items were carved from them."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / max(1, len(x))
    level = np.arange(256) - 128.0
    rms = float(np.sqrt((counts * level**2).sum() / max(1, len(x))))
    high = x >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    return f"rms={rms:.4f};crossings={crossings};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};embedded={embedded}"


def sniff(values: DataFrame, data: str = "data", declared: str | None = None) -> DataFrame:
    """Adds to each row of a binary column what is in it.

    media_type: type of the item at offset 0, else null. corrected: whether a
    declared type differs from it (null without either). items:
    array<struct<type, offset, length>>. Null data: null type, no items. All
    columns are kept, also such as have these names or share one; what is added
    then has underscores in front.
    """
    kind = "media_type string, items array<struct<type:string,offset:bigint,length:bigint>>"
    small_batches(values.sparkSession)

    @F.pandas_udf(kind)
    def look(column: pd.Series) -> pd.DataFrame:
        found = [items(bytes(x)) if x is not None else [] for x in column]
        return pd.DataFrame({"media_type": [next((k for k, at, _ in f if at == 0), None) for f in found], "items": [[{"type": k, "offset": a, "length": n} for k, a, n in f] for f in found]})

    names = values.columns
    inner = values.toDF(*[f"c{i}" for i in range(len(names))])
    seen = inner.withColumn("_seen", look(F.col(f"c{names.index(data)}")))
    added = [F.col("_seen.media_type").alias(free_name("media_type", names)), F.col("_seen.items").alias(free_name("items", names))]
    if declared:
        added.append((F.col(f"c{names.index(declared)}") != F.col("_seen.media_type")).alias(free_name("corrected", names)))
    return seen.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *added)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores in front as no column has, whatever its case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def carve(values: DataFrame, data: str = "data") -> DataFrame:
    """One row per item of a binary column: all other columns, then type, offset, length and bytes (names as in ``sniff``).

    Null data or data without items: no rows. Repeated rows are carved each.
    """
    names = values.columns
    rest = [i for i, n in enumerate(names) if i != names.index(data)]
    seen = sniff(values, data)
    inner = seen.toDF(*[f"c{i}" for i in range(len(seen.columns))])
    one = inner.select(*[f"c{i}" for i in rest], F.col(f"c{names.index(data)}").alias("_data"), F.explode(f"c{len(names) + 1}").alias("_item"))
    kept = [names[i] for i in rest]
    found = [F.col(f"_item.{n}").alias(free_name(n, kept)) for n in ("type", "offset", "length")]
    return one.select(*[F.col(f"c{i}").alias(names[i]) for i in rest], *found, F.expr("substring(_data, int(_item.offset) + 1, int(_item.length))").alias(free_name("bytes", kept)))


def stored_media(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Stores every text of (doc_id, text) as 8-bit samples, reads them back from the stored bytes by signature.

    The payload is the text's UTF-8, blanks appended to a positive multiple of
    192. Null text: as an empty one, 192 blanks. Columns: doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (and media: the stored form). Empty table: empty result.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    n = len(names) - (not with_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 64):
            out: list[list] = [[] for _ in range(n)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                stored = wav(raw + b" " * (-len(raw) % UNIT if raw else UNIT))
                found = items(stored)
                # The column says text; the signature says what it is, and what else is inside is carved.
                kind, at, size = next(x for x in found if x[1] == 0)
                back = wav_samples(stored, at, size)
                carved = ",".join(f"{k}:{zlib.crc32(stored[a : a + n]):08x}" for k, a, n in found if a)
                row = (doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"type={kind};corrected={int(kind != DECLARED)};" + feature(back, len(found) - 1) + f";carved={carved}", stored)
                for column, x in zip(out, row, strict=False):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=names[:n])

    rows = exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, schema + (", media binary" if with_bytes else ""))
