"""Media columns: signature sniffing, structure validation, carving.

An Aho-Corasick automaton finds all magic byte strings of a value in one pass.
The validator of each format then walks its structure from there - lengths,
checksums, end marks - and returns where the item ends, or nothing. The item at
offset 0 corrects the declared type; valid items further inside are carved.
Validators run from left to right and skip what an item already covers.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_slices, raw_texts

UNIT = 64
RATE = 8000
UNKNOWN = "application/octet-stream"
# Marks that end an item or lie inside it.
PDF, PDF_TABLE, PDF_END = b"%PDF-", b"startxref", b"%%EOF"
ZIP_END, JPEG_END = b"PK\x05\x06", b"\xff\xd9"


class Item(NamedTuple):
    kind: str
    start: int
    end: int


def _u(data: bytes, at: int, n: int, order: str) -> int:
    return int.from_bytes(data[at : at + n], order) if at + n <= len(data) else -1


class Marks:
    """What one pass of the automaton found in a value, by pattern; and where walks of a format's structure came to nothing.

    Walks of one format that meet at a place go on alike, so one that reaches a
    place where another failed fails too: all walks of a value together visit
    each place once.
    """

    def __init__(self, size: int):
        self.at: dict[bytes, list[int]] = {}
        self.size = size
        self.failed: set[tuple] = set()
        self.walk: list[tuple] = []
        self._zips: dict[int, int] | None = None

    def enter(self, *place) -> bool:
        """Notes a place of the walk; False if it is known to lead nowhere."""
        if place in self.failed:
            return False
        self.walk.append(place)
        return True

    def first(self, mark: bytes, low: int) -> int:
        found = self.at.get(mark, [])
        k = bisect_left(found, low)
        return found[k] if k < len(found) else -1

    def last(self, mark: bytes, low: int, high: int) -> int:
        found = self.at.get(mark, [])
        k = bisect_left(found, high) - 1
        return found[k] if k >= 0 and found[k] >= low else -1

    def zip_ends(self, data: bytes) -> dict[int, int]:
        """Where archives begin by what their end records say, and where these end; of several the last."""
        if self._zips is None:
            self._zips = {}
            for end in self.at.get(ZIP_END, []):
                note = _u(data, end + 20, 2, "little")
                begin = end - _u(data, end + 12, 4, "little") - _u(data, end + 16, 4, "little")
                if 0 <= begin and note >= 0 and end + 22 + note <= len(data):
                    self._zips[begin] = end
        return self._zips


def _png(data: bytes, at: int, marks: Marks) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(data) and marks.enter("png", p, first):
        n, kind = _u(data, p, 4, "big"), data[p + 4 : p + 8]
        if p + 12 + n > len(data) or (first and (kind != b"IHDR" or n != 13)):
            return None
        if zlib.crc32(data[p + 4 : p + 8 + n]) != _u(data, p + 8 + n, 4, "big"):
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p
    return None


def _gif(data: bytes, at: int, marks: Marks) -> int | None:
    if at + 13 > len(data):
        return None
    p = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 0x80 else 0)
    while p < len(data) and marks.enter("gif", p):
        mark = data[p]
        if mark == 0x3B:
            return p + 1
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 <= len(data):
            p += 11 + (3 << (data[p + 9] & 7) + 1 if data[p + 9] & 0x80 else 0)
        else:
            return None
        while p < len(data) and data[p]:
            if not marks.enter("gif block", p):
                return None
            p += 1 + data[p]
        p += 1
    return None


def _jpeg(data: bytes, at: int, marks: Marks) -> int | None:
    p, frame = at + 2, False
    while p + 4 <= len(data) and data[p] == 0xFF and marks.enter("jpeg", p, frame):
        mark = data[p + 1]
        if mark == 0xDA:
            end = marks.first(JPEG_END, p)
            return end + 2 if end >= 0 and frame else None
        if mark in (0x00, 0x01, 0xFF) or 0xD0 <= mark <= 0xD9:
            return None
        frame = frame or 0xC0 <= mark <= 0xC2
        n = _u(data, p + 2, 2, "big")
        if n < 2:
            return None
        p += 2 + n
    return None


def _bmp(data: bytes, at: int, marks: Marks) -> int | None:
    size, pixels, header = _u(data, at + 2, 4, "little"), _u(data, at + 10, 4, "little"), _u(data, at + 14, 4, "little")
    good = data[at + 6 : at + 10] == bytes(4) and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= pixels <= size and at + size <= len(data)
    return at + size if good else None


def _riff(data: bytes, at: int, marks: Marks) -> int | None:
    size = _u(data, at + 4, 4, "little")
    end = at + 8 + size
    if size < 4 or end > len(data):
        return None
    p, kinds = at + 12, []
    while p + 8 <= end:
        n = _u(data, p + 4, 4, "little")
        kinds.append(data[p : p + 4])
        p += 8 + n + n % 2
        if p > end:
            return None
    need = {b"WAVE": {b"fmt ", b"data"}, b"AVI ": {b"LIST"}}.get(data[at + 8 : at + 12])
    if data[at + 8 : at + 12] == b"WEBP":
        return end if kinds and kinds[0] in (b"VP8 ", b"VP8L", b"VP8X") else None
    return end if need and need <= set(kinds) else None


def _pdf(data: bytes, at: int, marks: Marks) -> int | None:
    """To the last end mark before the next document begins: an update in place adds further ones."""
    after = marks.first(PDF, at + 1)
    end = marks.last(PDF_END, at, after if after >= 0 else len(data))
    table = marks.first(PDF_TABLE, at)
    return end + 5 if end >= 0 and data[at + 5 : at + 6].isdigit() and 0 <= table < end else None


def _zip(data: bytes, at: int, marks: Marks) -> int | None:
    """An end record names where its archive begins, so an archive stored inside doesn't end the outer one."""
    end = marks.zip_ends(data).get(at)
    if end is None:
        return None
    start = _u(data, end + 16, 4, "little")
    return end + 22 + _u(data, end + 20, 2, "little") if data[at + start : at + start + 4] == b"PK\x01\x02" else None


def _gzip(data: bytes, at: int, marks: Marks) -> int | None:
    if _u(data, at + 2, 1, "little") != 8 or _u(data, at + 3, 1, "little") > 31:
        return None
    unpack, p = zlib.decompressobj(31), at
    try:
        while p < len(data) and not unpack.eof:
            unpack.decompress(data[p : p + 65536])
            p += 65536
    except zlib.error:
        return None
    return min(p, len(data)) - len(unpack.unused_data) if unpack.eof else None


def _ogg(data: bytes, at: int, marks: Marks) -> int | None:
    p = at
    while data[p : p + 4] == b"OggS" and p + 27 <= len(data) and marks.enter("ogg", p):
        n = data[p + 26]
        body = p + 27 + n
        end = body + sum(data[p + 27 : body])
        if end > len(data) or data[p + 4]:
            return None
        last, p = data[p + 5] & 4, end
        if last:
            return p
    return None


def _flac(data: bytes, at: int, marks: Marks) -> int | None:
    p, first = at + 4, True
    while p + 4 <= len(data) and marks.enter("flac", p, first):
        head, n = data[p], _u(data, p + 1, 3, "big")
        if first and (head & 0x7F or n != 34):
            return None
        p, first = p + 4 + n, False
        if head & 0x80:
            return len(data) if p < len(data) and data[p : p + 1] == b"\xff" else None
    return None


# Magic bytes of each format.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"BM": ("image/bmp", _bmp),
    b"RIFF": ("riff", _riff),
    PDF: ("application/pdf", _pdf),
    b"PK\x03\x04": ("application/zip", _zip),
    b"\x1f\x8b": ("application/gzip", _gzip),
    b"OggS": ("audio/ogg", _ogg),
    b"fLaC": ("audio/flac", _flac),
}
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}

_automaton: list = []


def automaton():
    if not _automaton:
        a = ahocorasick.Automaton()
        for word in (*MAGIC, PDF_TABLE, PDF_END, ZIP_END, JPEG_END):
            a.add_word(word.decode("latin-1"), word)
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def items(data: bytes) -> list[Item]:
    """The valid item at offset 0, if any, and the valid, non-overlapping items at later offsets."""
    marks = Marks(len(data))
    for last, word in automaton().iter(data.decode("latin-1")):
        marks.at.setdefault(word, []).append(last - len(word) + 1)
    starts = sorted((at, word) for word in MAGIC for at in marks.at.get(word, ()))
    out, free = [], 1
    for start, word in starts:
        if start and start < free:
            continue
        kind, check = MAGIC[word]
        marks.walk.clear()
        end = check(data, start, marks)
        if end is None:
            marks.failed.update(marks.walk)
            continue
        out.append(Item(RIFF_KINDS.get(data[start + 8 : start + 12], kind) if kind == "riff" else kind, start, end))
        if start:
            free = end
    return out


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """The bytes as 8-bit mono samples of a WAVE file; any even or odd length comes back as it was."""
    fmt = (1).to_bytes(2, "little") * 2 + rate.to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (8).to_bytes(2, "little")
    pad = bytes(len(payload) % 2)
    size = 4 + 8 + len(fmt) + 8 + len(payload) + len(pad)
    return b"RIFF" + size.to_bytes(4, "little") + b"WAVEfmt " + len(fmt).to_bytes(4, "little") + fmt + b"data" + len(payload).to_bytes(4, "little") + payload + pad


def wave_samples(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of a valid WAVE item."""
    p, rate = 12, 0
    while True:
        n, kind = _u(media, p + 4, 4, "little"), media[p : p + 4]
        if kind == b"fmt ":
            rate = _u(media, p + 12, 4, "little")
        if kind == b"data":
            return rate, media[p + 8 : p + 8 + n]
        p += 8 + n + n % 2


def wave_feature(rate: int, samples: bytes) -> str:
    """Rate, length, sum, energy about silence, crossings of it, greatest amplitude: integers, so equal on any machine."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    up = x >= 0
    return f"wav:{rate}:{len(x)}:{int(x.sum())}:{int((x * x).sum())}:{int((up[1:] != up[:-1]).sum())}:{int(np.abs(x).max(initial=0))}"


def store_as_wave(docs: DataFrame) -> DataFrame:
    """Each whole text as UTF-8, with zero bytes up to a positive multiple of 64, in a media column of no declared type."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        raw = raw_texts(part["text"])
        media = [to_wave(t + bytes(max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t))) for t in raw]
        return pa.RecordBatch.from_arrays(
            [part["doc_id"], pa.array(map(len, raw), pa.int64()), pa.array([UNKNOWN] * len(raw), pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"]
        )

    return map_slices(id_and_text(docs), lambda: step, "doc_id long, n_bytes long, declared string, media binary", rows=128)


def sniff_media(df: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """``(doc_id, declared, sniffed, corrected, length, feature, embedded)`` for each row.

    ``sniffed`` is the type whose structure is valid from offset 0, else null;
    ``corrected`` is that or the declared one; ``embedded`` are the carved items
    with their bytes. Null and empty media have none.
    """

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in part["media"].to_pylist():
            found = items(data or b"")
            outer = next((x for x in found if not x.start), None)
            feature = wave_feature(*wave_samples(data[: outer.end])) if outer and outer.kind == "audio/wav" else None
            rows.append((outer.kind if outer else None, outer.end if outer else None, feature, [{"kind": x.kind, "start": x.start, "body": data[x.start : x.end]} for x in found if x.start]))
        kind, end, feature, inner = zip(*rows, strict=True) if rows else ((), (), (), ())
        declared = part["declared"]
        corrected = [k or d for k, d in zip(kind, declared.to_pylist(), strict=True)]
        embedded = pa.array(inner, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("body", pa.binary())])))
        return pa.RecordBatch.from_arrays(
            [part["doc_id"], declared, pa.array(kind, pa.string()), pa.array(corrected, pa.string()), pa.array(end, pa.int64()), pa.array(feature, pa.string()), embedded],
            names=["doc_id", "declared", "sniffed", "corrected", "length", "feature", "embedded"],
        )

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[declared_col].cast("string").alias("declared"), df[media_col].alias("media"))
    schema = "doc_id long, declared string, sniffed string, corrected string, length long, feature string, embedded array<struct<kind: string, start: bigint, body: binary>>"
    return map_slices(rows, lambda: step, schema, rows=128)


def media_digest(stored: DataFrame) -> DataFrame:
    """What the stored form holds, read back through the sniffer: one row per row of ``store_as_wave``."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data, declared in zip(part["media"].to_pylist(), part["declared"].to_pylist(), strict=True):
            found = items(data)
            outer = found[0]
            rate, samples = wave_samples(data[: outer.end])
            inner = ",".join(f"{x.kind}@{x.start}+{x.end - x.start}" for x in found[1:])
            feature = f"{declared}>{outer.kind};{wave_feature(rate, samples)};{inner}"
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(found) - 1))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_embedded"]
        return pa.RecordBatch.from_arrays([part["doc_id"], part["n_bytes"], *map(pa.array, columns, kinds)], names=["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_embedded long"
    return map_slices(stored, lambda: step, schema, rows=128)
