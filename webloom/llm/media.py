"""MPEG audio columns: write a payload into frames, and read such streams back.

``pack`` stores bytes in MPEG-1 layer III frames of 240 bytes (80 kbit/s, 48 kHz,
24 ms each): header, CRC-16 over header and side information, side information,
and 192 bytes of payload as the frame's main data. A leading ID3v2 tag and an
Xing table (frames, bytes, 100 seek points) complete the file. ``parse``
resynchronises on any stream: it reads ID3v2 and ID3v1 tags, takes a frame
header only if another one or the end of the stream follows where it says,
reads Xing and VBRI tables, verifies checksums and gives exact durations in
samples and the byte offset of each frame. ``with_details`` does this for a
column of streams from anywhere.

Null and empty texts give one padded frame; a null stream has null details, one
without frames none. A text's stream depends on the text alone. Repeated rows give
repeated results, an empty table an empty one; columns with names used here do no
harm. Very long texts need memory in proportion to one text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import free, plus, tidy

UNIT = 192
FRAME = 240
SAMPLES = 1152
RATE = 48000
# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by version and layer, Hz by version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The checksum of protected frames: polynomial 0x8005, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    length: int
    samples: int
    mono: bool

    @property
    def side(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


def header(data: bytes, at: int) -> Header | None:
    """The frame header at a place, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(data[at + 1] >> 3 & 3)
    layer = 4 - (data[at + 1] >> 1 & 3)
    rate_at, bit_at, pad = data[at + 2] >> 2 & 3, data[at + 2] >> 4, data[at + 2] >> 1 & 1
    if version is None or layer == 4 or rate_at == 3 or bit_at in (0, 15):
        return None
    kbit, rate = BITRATES[1 if version == 1 else 2, layer][bit_at], RATES[version][rate_at]
    if layer == 1:
        length, samples = (12000 * kbit // rate + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 1 else 1152
        length = samples * 125 * kbit // rate + pad
    return Header(version, layer, not data[at + 1] & 1, kbit, rate, length, samples, data[at + 3] >> 6 == 3)


_HEAD = bytes((0xFF, 0xFA, 0x64, 0x00))  # MPEG-1, layer III, protected, 80 kbit/s, 48 kHz, stereo
_SIDE = bytes(32)
_LEAD = _HEAD + struct.pack(">H", crc16(_HEAD[2:] + _SIDE)) + _SIDE
_BODY = len(_LEAD)
_ID3 = b"ID3\x04\x00\x00" + bytes((0, 0, 0, 17)) + b"TENC" + bytes((0, 0, 0, 7, 0, 0)) + b"\x03webloo"


def pack(payload: bytes) -> bytes:
    """The payload, a positive multiple of 192 bytes, as an MPEG audio stream."""
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, :_BODY] = np.frombuffer(_LEAD, np.uint8)
    frames[1:, _BODY : _BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    seek = (np.arange(100, dtype=np.int64) * n // 100 + 1) * 256 // (n + 1)  # of each hundredth of the time, in 256ths of the bytes
    table = b"Xing" + struct.pack(">III", 7, n, (n + 1) * FRAME) + np.minimum(seek, 255).astype(np.uint8).tobytes()
    frames[0, _BODY : _BODY + len(table)] = np.frombuffer(table, np.uint8)
    return _ID3 + frames.tobytes()


@dataclass
class Stream:
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    head: Header | None = None
    samples: int = 0
    good: int = 0  # protected frames whose checksum holds
    bad: int = 0
    unchecked: int = 0  # protected frames of layers I and II, whose checksums cover parts that are not decoded here
    skipped: int = 0  # bytes passed over to find the next frame
    id3: int = 0
    tags: list[tuple[str, str | None]] = field(default_factory=list)  # frames of ID3v2 and fields of ID3v1; None: no text
    table: str = ""  # xing, vbri or empty
    table_damaged: bool = False  # by the checksum of its frame
    table_frames: int = -1
    table_bytes: int = -1
    seek: bytes = b""


def _frames_like(data: bytes, at: int, h: Header) -> int:
    """How many frames with the very header at ``at`` follow one another without a gap."""
    n = (len(data) - at) // h.length
    view = np.frombuffer(data, np.uint8, n * h.length, at).reshape(n, h.length)
    other = np.flatnonzero((view[:, :4] != view[0, :4]).any(axis=1))
    return int(other[0]) if len(other) else n


def parse(data: bytes) -> Stream:
    """The frames of any byte stream. Bytes that are no frames are passed over and counted."""
    s, at = Stream(), 0
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        begin, size = at, _seven(data[at + 6 : at + 10])
        at += 10 + size + (10 if data[at + 5] & 16 else 0)
        s.tags += _id3v2(data[begin : begin + 10 + size])
        s.id3 += 1
    end = len(data) - 128 if len(data) >= at + 128 and data[-128:-125] == b"TAG" else len(data)
    if end < len(data):
        s.tags += _id3v1(data[end:])
    offsets, lengths = [], []
    while at < end:
        h = header(data, at)
        if h is None or h.length < 4 or at + h.length > end or not (at + h.length == end or header(data, at + h.length)):
            nxt = data.find(b"\xff", at + 1, end)
            s.skipped += (nxt if nxt >= 0 else end) - at
            at = nxt if nxt >= 0 else end
            continue
        s.head = s.head or h
        if not offsets and not s.table and _table(data, at, h, s):
            own = Stream()
            _verify(data, at, 1, h, own)
            s.table_damaged = own.bad > 0
            at += h.length
            continue
        n = max(1, _frames_like(data[:end] if end != len(data) else data, at, h))
        _verify(data, at, n, h, s)
        offsets.append(at + h.length * np.arange(n, dtype=np.int64))
        lengths.append(np.full(n, h.length, np.int64))
        s.samples += n * h.samples
        at += n * h.length
    if offsets:
        s.offsets, s.lengths = np.concatenate(offsets), np.concatenate(lengths)
    return s


def _seven(raw: bytes) -> int:
    """A number of seven bits a byte."""
    value = 0
    for b in raw:
        value = value << 7 | b & 127
    return value


def _text(raw: bytes) -> str:
    """A text frame: its encoding and values, which NULs part."""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1") if raw else "latin-1"
    return raw[1:].decode(kind, "replace").rstrip("\0").replace("\0", " / ")


def _id3v2(tag: bytes) -> list[tuple[str, str | None]]:
    """The frames of a tag of version 2.2 to 2.4 in their order. A tag of another version, or cut in a frame, ends there."""
    major, flags, body = tag[3], tag[5], tag[10:]
    if major not in (2, 3, 4) or (major == 2 and flags & 64):
        return []
    if flags & 128 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 64:  # an extended header, which counts itself from version 2.4 on
        at = _seven(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    wide, out = (3 if major == 2 else 4), []
    head = 6 if major == 2 else 10
    while at + head <= len(body) and body[at]:
        name, count = body[at : at + wide].decode("latin-1"), body[at + wide : at + 2 * wide]
        size = _seven(count) if major == 4 else int.from_bytes(count, "big")
        form = body[at + 9] if major > 2 else 0
        raw = body[at + head : at + head + size]
        if len(raw) < size:
            break
        at += head + size
        packed = form & (12 if major == 4 else 192 if major == 3 else 0)  # compressed or encrypted
        lead = (form >> 6 & 1) + 4 * (form & 1) if major == 4 else form >> 5 & 1  # group, length
        raw = raw[lead:]
        if major == 4 and (form & 2 or flags & 128):
            raw = raw.replace(b"\xff\0", b"\xff")
        if packed or name[0] not in "TW":
            out.append((name, None))
        elif name[0] == "T" or name.startswith("WX"):
            out.append((name, _text(raw)))
        else:
            out.append((name, raw.split(b"\0")[0].decode("latin-1")))
    return out


def _id3v1(tag: bytes) -> list[tuple[str, str | None]]:
    """The fields of the 128 bytes at a stream's end that are not empty."""
    places = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97), "comment": (97, 127)}
    out = [(name, tag[a:b].split(b"\0")[0].decode("latin-1").rstrip()) for name, (a, b) in places.items()]
    if tag[125] == 0 and tag[126]:
        out.append(("track", str(tag[126])))
    return [(name, v) for name, v in out if v] + ([("genre", str(tag[127]))] if tag[127] != 255 else [])


def _table(data: bytes, at: int, h: Header, s: Stream) -> bool:
    x = at + 4 + 2 * h.protected + h.side
    if data[x : x + 4] in (b"Xing", b"Info") and x + 8 <= at + h.length:
        flags, x = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        s.table = "xing"
        if flags & 1:
            s.table_frames, x = int.from_bytes(data[x : x + 4], "big"), x + 4
        if flags & 2:
            s.table_bytes, x = int.from_bytes(data[x : x + 4], "big"), x + 4
        if flags & 4:
            s.seek = data[x : x + 100]
        return True
    v = at + 36
    if data[v : v + 4] == b"VBRI" and v + 26 <= at + h.length:
        s.table = "vbri"
        s.table_bytes, s.table_frames = struct.unpack(">II", data[v + 10 : v + 18])
        entries, _, width, _ = struct.unpack(">HHHH", data[v + 18 : v + 26])
        s.seek = data[v + 26 : v + 26 + entries * width]
        return True
    return False


def _verify(data: bytes, at: int, n: int, h: Header, s: Stream) -> None:
    """Layer III checksums cover the last two header bytes and the side information; equal ones are computed once."""
    if not h.protected:
        return
    if h.layer != 3 or h.length < 6 + h.side:
        s.unchecked += n
        return
    view = np.frombuffer(data, np.uint8, n * h.length, at).reshape(n, h.length)[:, 2 : 6 + h.side]
    same = (view == view[0]).all(axis=1)
    for row, count in [(view[0], int(same.sum())), *((r, 1) for r in view[~same])]:
        raw = row.tobytes()
        if crc16(raw[:2] + raw[4:]) == int.from_bytes(raw[2:4], "big"):
            s.good += count
        else:
            s.bad += count


def unpack(data: bytes, s: Stream | None = None) -> bytes:
    """The payload of a stream that ``pack`` wrote, taken from its frames' main data."""
    s = s or parse(data)
    if not len(s.offsets):
        return b""
    at = int(s.offsets[0])
    if len(s.offsets) * FRAME == int(s.offsets[-1]) + FRAME - at:
        return np.frombuffer(data, np.uint8, len(s.offsets) * FRAME, at).reshape(-1, FRAME)[:, _BODY : _BODY + UNIT].tobytes()
    return b"".join(data[o + _BODY : o + _BODY + UNIT] for o in s.offsets.tolist())


def feature(s: Stream) -> str:
    """Exact duration as a fraction of seconds, checksums, table and a digest of the seek offsets."""
    if s.head is None:
        return "none"
    d = gcd(s.samples, s.head.rate) or 1
    seek = hashlib.sha256(s.offsets.astype("<i8").tobytes()).hexdigest()[:16]
    return f"mpeg{s.head.version:g}-layer{s.head.layer};{s.head.rate}hz;frames={len(s.offsets)};seconds={s.samples // d}/{s.head.rate // d};crc={s.good}/{s.good + s.bad};table={s.table}:{s.table_frames};skipped={s.skipped};seek={seek}"


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


_OUT = "doc_id {id}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the text's MPEG stream in a binary column and its frame offsets in ``<media>_offsets``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            streams = [pack(padded((t or "").encode())) for t in b.column(at).to_pylist()]
            offsets = [parse(x).offsets.tolist() for x in streams]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(streams, pa.binary()), pa.array(offsets, pa.list_(pa.int64()))], names=[*b.schema.names, *names])

    names = [free(docs, media), free(docs, f"{media}_offsets")]
    return docs.mapInArrow(tidy(work), plus(docs.schema, **{names[0]: T.BinaryType(), names[1]: T.ArrayType(T.LongType())}))


_DETAILS = "struct<samples bigint, rate int, frames bigint, good bigint, bad bigint, unchecked bigint, skipped bigint, table string, table_frames bigint, table_damaged boolean, offsets array<bigint>, tags array<struct<name string, value string>>>"


def with_details(df: DataFrame, media: str = "media", details: str = "media_details") -> DataFrame:
    """``df`` with what a binary column of MPEG streams holds: duration (samples at a rate), frames and their offsets, checksums, table and tags."""

    def of(data: bytes | None) -> dict | None:
        if data is None:
            return None
        s = parse(data)
        counts = {k: getattr(s, k) for k in ("samples", "good", "bad", "unchecked", "skipped", "table", "table_frames", "table_damaged")}
        return counts | {"rate": s.head and s.head.rate, "frames": len(s.offsets), "offsets": s.offsets.tolist(), "tags": [{"name": n, "value": v} for n, v in s.tags]}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([of(x) for x in b.column(b.schema.get_field_index(media)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, name])

    name = free(df, details)
    schema = plus(df.schema, **{name: T._parse_datatype_string(_DETAILS)})
    kind = to_arrow_type(schema[name].dataType)
    return df.mapInArrow(tidy(work), schema)


def digest(docs: DataFrame) -> DataFrame:
    """For each document what was stored, what was read back, and the features of the stored stream."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                raw = (t.as_py() or "").encode()
                media = pack(padded(raw))
                s = parse(media)
                back = unpack(media, s)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(s)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    schema = _OUT.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return docs.select("doc_id", "text").mapInArrow(tidy(work), schema)
