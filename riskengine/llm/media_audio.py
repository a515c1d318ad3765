"""MPEG audio columns: writing payloads into MPEG-1 Layer III streams and reading them.

``encode`` stores bytes losslessly as the ancillary data of silent frames (all granules
have no main data), with an ID3v2 tag, an info frame with a seek table, a checksum in
every frame and a trailing ID3v1 tag. ``parse`` reads any MPEG-1/2/2.5 Layer I-III
stream, also of free format: it skips tags and damage, resynchronises where two headers
in a row agree, reads Xing/Info/VBRI tables, verifies the frames' checksums, and gives
the exact duration as a fraction (without the encoder's delay and padding, where the
table names them) and every frame's byte offset and first sample.

Defined results: a null payload is an empty one; bytes without a frame have no duration;
a damaged frame is skipped to the next header that a second one confirms; a frame of free
format is as long as the way to the next header like it, and the last one as the one
before; equal bytes give equal results; an empty table gives an empty one. Extra columns
are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: kbit/s by index for MPEG-1 layers I, II, III and MPEG-2/2.5 layers I, II and III; sampling rates.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

# Fixed values of the format: bits of a Layer II allocation by subband, for the tables of MPEG-1 at high and at low rates and of MPEG-2.
ALLOCATION_BITS = {"high": (4,) * 11 + (3,) * 12 + (2,) * 7, "low": (4,) * 2 + (3,) * 10, "lsf": (4,) * 4 + (3,) * 7 + (2,) * 19}

RATE_HZ = 48000
#: MPEG-1 Layer III at 48 kHz: 3 bytes a frame for each kbit/s.
_ROOM = {k: 3 * BITRATES[1, 3][k] - 23 for k in range(1, 15)}
_HEAD_BYTES = 4 + 2 + 17  # header, checksum and side information of one channel


def _crc_table() -> np.ndarray:
    t = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        t[i] = c
    return t


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The format's checksum (polynomial 0x8005, start 0xFFFF) of each row of bytes."""
    c = np.full(rows.shape[0], 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


def crc16_bits(data: bytes, bits: int) -> int:
    """The checksum of the first ``bits`` bits."""
    c = 0xFFFF
    for byte in data[: bits // 8]:
        c = (c << 8 & 0xFFFF) ^ int(_CRC[c >> 8 ^ byte])
    for k in range(bits % 8):
        top = (c >> 15) ^ (data[bits // 8] >> (7 - k) & 1)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def _header(index: int) -> bytes:
    """MPEG-1 Layer III, with checksum, 48 kHz, no padding, one channel."""
    return bytes((0xFF, 0xFA, (index << 4) | (1 << 2), 0xC0))


def _crc_of_silence(index: int) -> bytes:
    row = np.frombuffer(_header(index)[2:] + bytes(17), np.uint8)[None, :]
    return struct.pack(">H", int(crc16(row)[0]))


_SILENT = {k: _header(k) + _crc_of_silence(k) + bytes(17) for k in range(1, 15)}


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The payload as an MPEG stream; ``n_bytes`` of it count, the rest is padding (kept in the tag)."""
    body, at = bytearray(), 0
    sizes: list[int] = []
    while at < len(payload):
        left = len(payload) - at
        index = next((k for k in range(1, 15) if _ROOM[k] >= left), 14)
        part = payload[at : at + _ROOM[index]]
        body += _SILENT[index] + part + bytes(_ROOM[index] - len(part))
        sizes.append(3 * BITRATES[1, 3][index])
        at += _ROOM[index]
    lead = 3 * BITRATES[1, 3][5]  # the info frame's own size
    frames, total = len(sizes), lead + len(body)
    ends = np.concatenate([[0], np.cumsum(sizes)]) + lead
    toc = bytes(min(255, int(ends[k * frames // 100]) * 256 // total) for k in range(100))
    kind = b"Info" if len(set(sizes)) == 1 else b"Xing"
    info = _SILENT[5] + kind + struct.pack(">III", 7, frames, total) + toc
    info += bytes(lead - len(info))
    text = b"\x00payload\x00" + f"{n_bytes}/{len(payload)}".encode()
    frame = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + _syncsafe(len(frame)) + frame
    return tag + info + bytes(body) + b"TAG" + bytes(125)


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


@dataclass
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    checked: bool
    kbps: int
    rate: int
    channels: int
    size: int  # 0 for free format, whose frames say no bit rate
    samples: int
    shared_from: int  # the first subband whose allocation both channels share
    padding: int  # bytes


def read_header(b: bytes, at: int) -> Header | None:
    """The frame header at a place, or None."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate_index = (b[at + 1] >> 3) & 3, 4 - ((b[at + 1] >> 1) & 3), b[at + 2] >> 4, (b[at + 2] >> 2) & 3
    if version == 1 or layer == 4 or index == 15 or rate_index == 3:
        return None
    kbps, rate, pad = BITRATES[1 if version == 3 else 2, layer][index], RATES[version][rate_index], (b[at + 2] >> 1) & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    mode, shared = b[at + 3] >> 6, 4 * ((b[at + 3] >> 4 & 3) + 1)
    return Header(version, layer, not b[at + 1] & 1, kbps, rate, 1 if mode == 3 else 2, size if index else 0, samples, shared if mode == 1 else 32, pad * (4 if layer == 1 else 1))


def _free_size(b: bytes, at: int, end: int) -> int:
    """The length without padding of a free-format frame: the way to the next header like it, or 0."""
    like, mask = b[at : at + 2], 0xFC
    nxt = b.find(like, at + 4, end)
    while nxt >= 0:
        if nxt + 4 <= end and b[nxt + 2] & mask == b[at + 2] & mask:
            return nxt - at - read_header(b, at).padding
        nxt = b.find(like, nxt + 1, end)
    return 0


def _checked_bits(b: bytes, at: int, h: Header) -> int:
    """How many bits behind the checksum of a Layer I or II frame it covers: allocations, and in Layer II the selectors."""
    if h.layer == 1:
        return 4 * (32 if h.channels == 1 else 32 + h.shared_from)
    each = h.kbps / h.channels
    if h.version != 3:
        widths = ALLOCATION_BITS["lsf"]
    elif each < 56:
        widths = ALLOCATION_BITS["low"][: 12 if h.rate == 32000 else 8]
    else:
        widths = ALLOCATION_BITS["high"][: 27 if h.rate == 48000 or each < 96 else 30]
    bits, place, chosen = int.from_bytes(b[at + 6 : at + 6 + 64], "big"), 0, 0
    for k, width in enumerate(widths):
        own = 1 if h.channels == 1 or k >= h.shared_from else 2
        for _ in range(own):
            used = bits >> (512 - place - width) & ((1 << width) - 1) > 0
            chosen += used * (h.channels if own == 1 else 1)
            place += width
    return place + 2 * chosen


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, object] = field(default_factory=dict)
    frame_offset: list[int] = field(default_factory=list)
    frame_size: list[int] = field(default_factory=list)
    first_sample: list[int] = field(default_factory=list)
    duration: Fraction = Fraction(0)
    samples: int = 0
    rate: int = 0
    trimmed: int = 0  # samples of the encoder's delay and padding
    checked: int = 0
    good: int = 0
    skipped_bytes: int = 0
    resyncs: int = 0


def _side_bytes(h: Header) -> int:
    return (17 if h.channels == 1 else 32) if h.version == 3 else (9 if h.channels == 1 else 17)


def _id3v2(b: bytes, out: Audio) -> int:
    """Read a leading tag of version 2.2, 2.3 or 2.4; where the audio begins."""
    if b[:3] != b"ID3" or len(b) < 10 or any(x & 0x80 for x in b[6:10]):
        return 0
    version, flags, end = b[3], b[5], min(len(b), 10 + _unsafe(b[6:10]))
    body, at, joined = b[10:end], 0, lambda x: x.replace(b"\xff\x00", b"\xff")
    if flags & 0x80 and version < 4:
        body = joined(body)
    if flags & 0x40 and version > 2 and len(body) >= 4:  # an extended header
        at = 4 + int.from_bytes(body[:4], "big") if version == 3 else _unsafe(body[:4])
    head, name_size = (6, 3) if version == 2 else (10, 4)
    while at + head <= len(body) and body[at] and version in (2, 3, 4):
        n = body[at + name_size : at + 2 * name_size]
        size = _unsafe(n) if version == 4 else int.from_bytes(n, "big")
        name, text = body[at : at + name_size].decode("latin-1"), body[at + head : at + head + size]
        if version == 4:
            text = joined(text) if (flags & 0x80 or body[at + 9] & 2) else text
            text = text[4:] if body[at + 9] & 1 else text
        if name[0] == "T" and text:
            how = ("latin-1", "utf-16", "utf-16-be", "utf-8")[text[0]] if text[0] < 4 else "latin-1"
            said = text[1:].decode(how, "replace").split("\x00")
            if name in ("TXXX", "TXX") and len(said) > 1:
                name, said = f"{name}:{said[0]}", [x.removeprefix("\ufeff") for x in said[1:]]
            out.tags[name] = said[0]
        at += head + size
    return end + (10 if flags & 0x10 else 0)


def _vbr(b: bytes, at: int, h: Header) -> dict[str, object]:
    """The variable-bitrate table of the first frame, if it has one."""
    x = at + 4 + 2 * h.checked + _side_bytes(h)
    if b[x : x + 4] in (b"Xing", b"Info") and x + 8 <= len(b):
        flags, got = int.from_bytes(b[x + 4 : x + 8], "big"), {"kind": b[x : x + 4].decode()}
        x += 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                got[name] = int.from_bytes(b[x : x + 4], "big")
                x += 4
        if flags & 4:
            got["toc"] = b[x : x + 100]
            x += 100
        x += 4 * (flags & 8 > 0)
        if b[x : x + 4] in (b"LAME", b"Lavf", b"Lavc") and x + 24 <= len(b):
            both = int.from_bytes(b[x + 21 : x + 24], "big")
            got |= {"encoder": b[x : x + 9].rstrip(b"\x00 ").decode("latin-1"), "delay": both >> 12, "padding": both & 0xFFF}
        return got
    x = at + 36
    if b[x : x + 4] == b"VBRI" and x + 26 <= len(b):
        size, frames, entries, scale, width = struct.unpack(">IIHHH", b[x + 10 : x + 24])
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": b[x + 26 : x + 26 + entries * width], "scale": scale}
    return {}


def parse(b: bytes) -> Audio:
    out = Audio()
    at, end = _id3v2(b, out), len(b)
    if end - at >= 128 and b[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["ID3v1"] = b[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
    synced, first = False, True
    to_check: dict[int, list[int]] = {}
    at_rate: dict[int, int] = {}
    free = 0
    while at < end:
        h = read_header(b, at)
        if h and not h.size:
            free = (_free_size(b, at, end) if not synced or not free else free)
            h.size = free + h.padding if free else 0
            h.kbps = h.size * 8 * h.rate // (h.samples * 1000)
        if h and not 4 < h.size <= end - at:
            h = None
        if h and not synced:  # after damage two headers in a row have to agree, or the stream ends here
            after = at + h.size
            n = read_header(b, after) if after < end else h
            if n is None or (n.version, n.layer, n.rate) != (h.version, h.layer, h.rate):
                h = None
        if h is None:
            if synced:
                out.resyncs += 1
            synced, nxt = False, b.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped_bytes += nxt - at
            at = nxt
            continue
        synced = True
        if h.checked and h.layer == 3:
            to_check.setdefault(_side_bytes(h), []).append(at)
        elif h.checked:
            bits = _checked_bits(b, at, h)
            out.checked += 1
            out.good += crc16_bits(b[at + 2 : at + 4] + b[at + 6 : at + 7 + bits // 8] + b"\x00", 16 + bits) == int.from_bytes(b[at + 4 : at + 6], "big")
        if first and h.layer == 3 and (table := _vbr(b, at, h)):
            out.vbr = table
        else:
            out.frame_offset.append(at)
            out.frame_size.append(h.size)
            out.first_sample.append(out.samples)
            out.samples += h.samples
            at_rate[h.rate] = at_rate.get(h.rate, 0) + h.samples
        first = False
        at += h.size
    raw = np.frombuffer(b, np.uint8)
    for side, places in to_check.items():
        p = np.array(places)
        rows = np.concatenate([raw[p[:, None] + np.array([2, 3])], raw[p[:, None] + 6 + np.arange(side)]], axis=1)
        said = raw[p + 4].astype(np.uint16) << np.uint16(8) | raw[p + 5]
        out.checked += len(p)
        out.good += int((crc16(rows) == said).sum())
    out.rate = next(iter(at_rate), 0)
    if at_rate:  # the first frames' rate
        out.trimmed = min(int(out.vbr.get("delay", 0)) + int(out.vbr.get("padding", 0)), at_rate[out.rate])
        at_rate[out.rate] -= out.trimmed
    out.duration = sum((Fraction(n, rate) for rate, n in at_rate.items()), Fraction(0))
    return out


def payload_of(b: bytes, a: Audio) -> tuple[bytes, int]:
    """The stored bytes and how many of them count."""
    n_bytes, size = map(int, a.tags["TXXX:payload"].split("/"))
    got = b"".join(b[at + _HEAD_BYTES : at + n] for at, n in zip(a.frame_offset, a.frame_size, strict=True))
    return got[:size], n_bytes


def _each(df: DataFrame, fn, schema: str) -> DataFrame:
    """Apply a function of one binary value to the second column, with rows batched by bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = None
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                v = batch.column(1)[i].as_py()
                rows.append((batch.column(0)[i].as_py(), *fn(v)))
                held += len(v or b"")
                if held > 8 << 20 or i + 1 == batch.num_rows:
                    out_schema = out_schema or pa.schema([(n, _ARROW.get(t, batch.schema.field(0).type)) for n, t in (c.split(" ") for c in schema.split(", "))])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out_schema, strict=True)], schema=out_schema)
                    rows, held = [], 0

    return df.mapInArrow(run, schema)


_ARROW = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """A ``media`` column: each text's UTF-8 bytes, padded with 0 to a positive multiple of ``unit``, as MPEG audio."""

    def one(text: bytes | None) -> tuple[bytes]:
        raw = text or b""
        return (encode(raw + bytes(-len(raw) % unit or (0 if raw else unit)), len(raw)),)

    kind = docs.schema[id_col].dataType.simpleString()
    return _each(docs.select(id_col, F.encode(F.col(text_col), "UTF-8").alias("_raw")), one, f"{id_col} {kind}, media binary")


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What a media column's streams hold.

    ``n_frames``, ``samples`` and ``trimmed`` of them, ``rate``, ``duration_num``/``duration_den`` (exact seconds),
    ``checksums``/``checksums_good``, ``skipped_bytes``, ``resyncs``, ``vbr_kind``,
    ``vbr_frames``, ``seek_offsets`` (the byte offset of every frame) and ``seek_samples``.
    """

    def one(b: bytes | None) -> tuple:
        a = parse(b or b"")
        return (len(a.frame_offset), a.samples, a.trimmed, a.rate, a.duration.numerator, a.duration.denominator, a.checked, a.good, a.skipped_bytes, a.resyncs, str(a.vbr.get("kind", "")), int(a.vbr.get("frames", 0)), a.frame_offset, a.first_sample)

    kind = media.schema[id_col].dataType.simpleString()
    return _each(media.select(id_col, media_col), one, f"{id_col} {kind}, n_frames long, samples long, trimmed long, rate long, duration_num long, duration_den long, checksums long, checksums_good long, skipped_bytes long, resyncs long, vbr_kind string, vbr_frames long, seek_offsets array<long>, seek_samples array<long>")


def digest_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Read payloads back from a media column of ``store_texts`` and digest them, with the stream's features.

    ``duration_num``/``duration_den`` are its exact seconds, ``seek_offsets`` and
    ``seek_samples`` the byte offset and first sample of every frame.
    """

    def one(b: bytes) -> tuple:
        a = parse(b)
        payload, n = payload_of(b, a)
        seek = np.array([a.frame_offset, a.first_sample], "<i8").tobytes()
        feature = (
            f"mpeg1/layer3;rate={a.rate};frames={len(a.frame_offset)};samples={a.samples};duration={a.duration.numerator}/{a.duration.denominator}"
            f";crc={a.good}/{a.checked};vbr={a.vbr.get('kind', '')}:{a.vbr.get('frames', 0)}:{a.vbr.get('bytes', 0)};skipped={a.skipped_bytes};seek_crc32={zlib.crc32(seek)}"
        )
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(b), hashlib.sha256(b).hexdigest(), feature, a.duration.numerator, a.duration.denominator, a.frame_offset, a.first_sample

    kind = media.schema[id_col].dataType.simpleString()
    return _each(media.select(id_col, media_col), one, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_num long, duration_den long, seek_offsets array<long>, seek_samples array<long>")
