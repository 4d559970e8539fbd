"""MPEG audio columns: texts stored in, and read back from, MPEG-1 layer III.

``store`` writes each payload into the ancillary bytes of silent, checksummed
frames behind an ID3v2 tag and a Xing variable-bitrate frame. ``read`` parses
any MPEG 1/2/2.5 layer I-III stream: ID3v2 and ID3v1 tags, frame headers
(resynchronising over junk), CRC-16 checksums of all layers, Xing, Info and VBRI
tables (counts and seek points are held against the frames found), the exact
duration as samples over rate, and the byte offset of every frame. An ID3v1 tag
counts as one only where no frame that ends with the stream covers its bytes.
Frames of free format (bit-rate index 0) are passed over as junk.

Null text counts as empty; the payload is padded with zero bytes to a positive
multiple of 64. Null media give nulls. Equal texts give equal media. Media of
other makers are parsed alike; their tags never fail a row, and without the own
tags they hold no payload.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 64

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version 1, layer).
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}

READ = (
    "payload binary, n_bytes bigint, frames bigint, samples bigint, rate int, tags map<string,string>, "
    "vbr_frames bigint, vbr_bytes bigint, vbr_ok boolean, seek_ok boolean, crc_checked bigint, crc_bad bigint, "
    "payload_crc_ok boolean, resyncs bigint, min_kbps int, max_kbps int, offsets array<bigint>"
)


#: Layer II: (subbands, bits of their allocations by first subband); fixed values of the same standards.
ALLOCATIONS = {
    "a": (27, ((0, 4), (11, 3), (23, 2))),
    "b": (30, ((0, 4), (11, 3), (23, 2))),
    "c": (8, ((0, 4), (2, 3))),
    "d": (12, ((0, 4), (2, 3))),
    "low": (30, ((0, 4), (4, 3), (11, 2))),
}


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 of the MPEG audio standard (polynomial 0x8005, start 0xFFFF) over the first ``bits``."""
    crc, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        for k in range(7, 7 - min(8, left), -1):
            top = (crc >> 15) ^ (byte >> k & 1)
            crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
        left -= 8
        if left <= 0:
            break
    return crc


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def take(self, n: int) -> int:
        self.at += n
        return self.value >> max(0, self.size - self.at) & (1 << n) - 1


def protected_bits(four: bytes, body: bytes) -> int:
    """How many bits behind the checksum it covers: side information in layer III, bit
    allocations in layer I, and in layer II also the scale factor selections."""
    size, samples, hz, kbps, _, side, (version, layer, _) = header(four)
    if layer == 3:
        return 8 * side
    mode, extension = four[3] >> 6, four[3] >> 4 & 3
    channels = 1 if mode == 3 else 2
    joined = 4 * (extension + 1) if mode == 1 else 32
    if layer == 1:
        return 4 * 32 if channels == 1 else 4 * (2 * joined + 32 - joined)
    each = kbps // channels
    if version != 3:
        name = "low"
    elif each < 56:
        name = "d" if hz == 32000 else "c"
    else:
        name = "a" if each <= 80 or hz == 48000 else "b"
    limit, widths = ALLOCATIONS[name]
    bits, selections = _Bits(body[:64]), 0
    for band in range(limit):
        width = next(w for start, w in reversed(widths) if band >= start)
        if channels == 1 or band < joined:
            selections += sum(bits.take(width) > 0 for _ in range(channels))
        else:
            selections += 2 * (bits.take(width) > 0)
    return bits.at + 2 * selections


@lru_cache(maxsize=65536)
def header(four: bytes) -> tuple | None:
    """(frame bytes, samples, rate, kbit/s, has CRC, side info bytes, kind), or None if invalid."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    first = version == 3
    kbps = BITRATES[first, layer][index - 1]
    hz = RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    samples, pad = SAMPLES[first, layer], four[2] >> 1 & 1
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples * 125 * kbps // hz + pad
    mono = four[3] >> 6 == 3
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return size, samples, hz, kbps, not four[1] & 1, side if layer == 3 else 0, (version, layer, rate)


def _frame(index: int, body: bytes) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0))
    size, side = header(head)[0], bytes(17)
    out = head + crc16(head[2:] + side).to_bytes(2, "big") + side + body
    return out + bytes(size - len(out))


def _room(index: int) -> int:
    return BITRATES[True, 3][index - 1] * 9 // 2 - 23


def _tag(values: dict[str, str]) -> bytes:
    body = b""
    for key, value in values.items():
        text = b"\0" + key.encode("latin-1") + b"\0" + value.encode("latin-1")
        body += b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    n = len(body)
    return b"ID3\3\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body


def store_bytes(raw: bytes) -> bytes:
    """The MPEG stream that holds ``raw``, zero-padded to a multiple of 64."""
    payload = raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))
    top, frames = _room(14), []
    for at in range(0, len(payload), top):
        piece = payload[at : at + top]
        frames.append(_frame(next(i for i in range(1, 15) if _room(i) >= len(piece)), piece))
    total = 144 + sum(map(len, frames))
    places, at = [], 144
    for f in frames:
        places.append(at)
        at += len(f)
    toc = bytes(min(255, places[min(len(places) - 1, p * len(places) // 100)] * 256 // total) for p in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    tag = _tag({"n_bytes": str(len(raw)), "payload_bytes": str(len(payload)), "payload_crc32": str(zlib.crc32(payload))})
    return tag + _frame(1, xing) + b"".join(frames)


_CODECS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _text(data: bytes) -> tuple[str, str]:
    """An encoded text frame's (first, second) part; bytes that do not fit are replaced."""
    codec = _CODECS.get(data[0], "latin-1") if data else "latin-1"
    first, _, second = data[1:].decode(codec, "replace").partition("\0")
    return first, second.lstrip("\ufeff").rstrip("\0")


def _tags(media: bytes) -> tuple[dict[str, str], int]:
    """The text frames of a leading ID3v2.3/2.4 tag (TXXX under their own names) and the place behind it."""
    if media[:3] != b"ID3" or len(media) < 10:
        return {}, 0
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3] if len(b) == 4 else 0
    version, flags, end, out = media[3], media[5], min(len(media), 10 + safe(media[6:10])), {}
    body = media[10:end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40:  # an extended header; its size counts itself in 2.4 only
        at = safe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    while at + 10 <= len(body) and body[at]:
        name, n = body[at : at + 4].decode("latin-1"), safe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        data, marks = body[at + 10 : at + 10 + n], body[at + 9]
        if version == 4 and (marks & 2 or flags & 0x80):
            data = data.replace(b"\xff\0", b"\xff")
        if version == 4 and marks & 1:
            data = data[4:]  # a length indicator
        if name[0] == "T" and not marks & 0x0C:  # neither compressed nor encrypted
            first, second = _text(data)
            out[first if name == "TXXX" else name] = second if name == "TXXX" else first
        at += 10 + n
    if flags & 0x10 and version == 4:
        end = min(len(media), end + 10)  # a footer
    return out, end


def _old_tag(media: bytes) -> dict[str, str]:
    """Title, artist, album and year of an ID3v1 tag."""
    last = media[-128:]
    field = lambda a, b: last[a:b].split(b"\0")[0].decode("latin-1").rstrip()
    return {k: v for k, v in (("TIT2", field(3, 33)), ("TPE1", field(33, 63)), ("TALB", field(63, 93)), ("TYER", field(93, 97))) if v}


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def _table(frame: bytes, start: int) -> tuple | None:
    """(kind, frames, bytes, seek points as a list, their unit) of a Xing, Info or VBRI frame."""
    big = lambda a, n: int.from_bytes(frame[a : a + n], "big")
    if frame[start : start + 4] in (b"Xing", b"Info"):
        flags, at = big(start + 4, 4), start + 8
        frames, at = (big(at, 4), at + 4) if flags & 1 else (None, at)
        size, at = (big(at, 4), at + 4) if flags & 2 else (None, at)
        return "Xing", frames, size, list(frame[at : at + 100]) if flags & 4 else None, 1
    if frame[36:40] == b"VBRI":
        size, frames, n, scale, width, per = big(46, 4), big(50, 4), big(54, 2), big(56, 2), big(58, 2), big(60, 2)
        return "VBRI", frames, size, [scale * big(62 + i * width, width) for i in range(n)], per
    return None


def _seek_ok(table: tuple, offsets: list[int], first: int, end: int) -> bool | None:
    """Whether the seek points lie on the frames they stand for, as nearly as they can say."""
    kind, _, _, points, per = table
    if points is None or not offsets:
        return None
    if kind == "Xing":
        total, n = end - first, len(offsets)
        places = [offsets[min(n - 1, p * n // 100)] - first for p in range(len(points))]
        return all(abs(x * total / 256 - place) <= total / 256 or x == 255 for x, place in zip(points, places, strict=True))
    at = 0
    for i, step in enumerate(points[:-1], 1):
        at += step
        if i * per < len(offsets) and at != offsets[i * per] - offsets[0]:
            return False
    return True


def read_bytes(media: bytes) -> tuple:
    """Parses a stream; the fields of ``READ`` in order."""
    tags, at = _tags(media)
    end = len(media)
    old = end - 128 if media[-128:-125] == b"TAG" and end - 128 >= at else end  # a frame's own bytes may spell it
    body, offsets, kbps = [], [], set()
    samples = rate = checked = bad = resyncs = 0
    table, kind, first, lost = None, None, at, False
    while at + 4 <= end:
        h = header(media[at : at + 4])
        if h and (kind is None or h[6] == kind) and at + h[0] <= end:
            after = header(media[at + h[0] : at + h[0] + 4])
            if at + h[0] != end and not (after and after[6] == h[6]) and at + h[0] + 4 <= end and kind is None:
                h = None
            elif at <= old < at + h[0] != end:  # cut off by a tag behind it
                h = None
        else:
            h = None
        if h is None:
            found = media.find(b"\xff", at + 1, old if at <= old else end)
            if found < 0 and at <= old < end:
                end, tags = old, _old_tag(media) | tags
                break
            lost, at = True, end if found < 0 else found
            continue
        resyncs, lost, kind = resyncs + lost, False, h[6]
        start = at + 4
        if h[4]:
            bits = protected_bits(media[at : at + 4], media[at + 6 : at + h[0]])
            covered = media[at + 2 : at + 4] + media[at + 6 : at + 6 + (bits + 7) // 8]
            checked += 1
            bad += crc16(covered, 16 + bits) != int.from_bytes(media[at + 4 : at + 6], "big")
            start += 2
        start += h[5]
        if table is None and not offsets and (table := _table(media[at : at + h[0]], start - at)):
            first = at
        else:
            offsets.append(at)
            kbps.add(h[3])
            samples += h[1]
            body.append(media[start : at + h[0]])
        rate, at = h[2], at + h[0]
    payload = _cut(body, _number(tags.get("payload_bytes")) or 0)
    crc = _number(tags.get("payload_crc32"))
    counts = (None, None) if table is None else table[1:3]
    vbr_ok = None if table is None else counts[0] in (None, len(offsets)) and counts[1] in (None, end - first)
    return (payload, _number(tags.get("n_bytes")) or 0, len(offsets), samples, rate, tags, *counts, vbr_ok, table and _seek_ok(table, offsets, first, end),
            checked, bad, None if crc is None else zlib.crc32(payload) == crc, resyncs, min(kbps, default=0), max(kbps, default=0), offsets)


def _cut(body: list[bytes], n: int) -> bytes:
    """The payload: each frame holds as much of it as it has room for."""
    return b"".join(body)[:n]


def _store(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: store_bytes((t or "").encode()))


def _read(media: pd.Series) -> pd.DataFrame:
    names = [x.strip().split(" ")[0] for x in READ.replace("map<string,string>", "map").split(", ")]
    return pd.DataFrame([(None,) * len(names) if m is None else read_bytes(m) for m in media], columns=names).astype(object)


def store(text: Column) -> Column:
    """MPEG bytes that hold ``text`` losslessly; null text counts as empty."""
    return F.pandas_udf(_store, "binary")(F.coalesce(text, F.lit("")))


def read(media: Column) -> Column:
    """Struct of what a stream holds (see ``READ``); null for null media."""
    return F.pandas_udf(_read, READ)(media)


def feature(parsed: Column) -> Column:
    """One line of the parsed properties: exact duration, rates, checks."""
    return F.format_string(
        "frames=%d;samples=%d;rate=%d;kbps=%d-%d;crc_bad=%d/%d;resyncs=%d;vbr_ok=%s;seek_ok=%s;payload_ok=%s;last_offset=%d",
        parsed["frames"], parsed["samples"], parsed["rate"], parsed["min_kbps"], parsed["max_kbps"], parsed["crc_bad"],
        parsed["crc_checked"], parsed["resyncs"], parsed["vbr_ok"].cast("string"), parsed["seek_ok"].cast("string"), parsed["payload_crc_ok"].cast("string"), F.try_element_at(parsed["offsets"], F.lit(-1)),
    )
