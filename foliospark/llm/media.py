"""MPEG audio columns: resynchronising parser, tag and table readers, and a carrier writer.

``parse`` walks a byte string the way a player that lost its place does: it skips an
ID3v2 tag, hunts for a frame header, and accepts one only if the header is valid and
the next header stands where this frame ends (or the data ends there), or its checksum holds. It reads the
Xing/Info and VBRI tables, verifies each frame's CRC-16 where one is present, and
returns exact durations (samples over rate) and the byte offset of every frame.

``carry`` stores any payload losslessly as silent MPEG-1 Layer III: every frame has
empty side information, so its main data is ancillary data by the standard, which a
decoder skips; the payload's bytes travel there. The frame unit is 144 * rate /
frequency bytes, the payload's length stands in a TXXX tag.

Defined cases: null counts as empty; data without any frame gives no frames, zero
duration and an empty payload; cut or damaged frames are counted, never raised.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of ISO 11172-3 and 13818-3: kbit/s by (version 1?, layer) and index, Hz by version.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
FREQUENCIES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
LENGTH_TAG = "payload-bytes"

SCHEMA = (
    "version string, layer int, frequency int, channels int, frames int, samples long, duration double, "
    "variable boolean, table_frames long, table_bytes long, crc_ok int, crc_bad int, skipped long, "
    "tags map<string,string>, offsets array<long>, payload binary"
)


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    layer: int
    protected: bool
    bitrate: int
    frequency: int
    size: int
    samples: int
    channels: int

    @property
    def side(self) -> int:
        """Bytes of side information of Layer III."""
        if self.layer != 3:
            return 0
        return (32 if self.channels == 2 else 17) if self.version == 3 else (17 if self.channels == 2 else 9)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None if they are not a valid one."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, freq = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or freq == 3 or four[3] & 3 == 2:
        return None
    kbit, hz, pad = BITRATES[version == 3, layer][rate], FREQUENCIES[version][freq], four[2] >> 1 & 1
    if layer == 1:
        size, samples = (12000 * kbit // hz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * 1000 * kbit // hz + pad
    return Header(version, layer, not four[1] & 1, kbit, hz, size, samples, 1 if four[3] >> 6 == 3 else 2)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ (0x8005 if value & 0x8000 else 0)) & 0xFFFF
        table.append(value)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ _CRC[value >> 8 ^ byte]
    return value


def _sync_safe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _text(body: bytes) -> list[str]:
    """The strings of a text frame of ID3v2, by its encoding byte."""
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 0, "latin-1")
    return body[1:].decode(code, "replace").rstrip("\0").split("\0")


def read_tags(data: bytes) -> tuple[dict[str, str], int]:
    """Tags of ID3v2 at the start, and where they end."""
    tags: dict[str, str] = {}
    start, end = 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10 and not any(b & 0x80 for b in data[6:10]):
        size, major, at = _sync_safe(data[6:10]), data[3], 10
        start = min(end, 10 + size + (10 if data[5] & 0x10 else 0))
        if data[5] & 0x40 and at + 4 <= end:
            at += _sync_safe(data[at : at + 4]) if major == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
        while major >= 3 and at + 10 <= min(start, 10 + size) and data[at]:
            name = data[at : at + 4].decode("latin-1")
            length = _sync_safe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            body = data[at + 10 : at + 10 + length]
            if name == "TXXX" and len(parts := _text(body)) >= 2:
                tags[parts[0]] = parts[1]
            elif name[0] == "T" and body:
                tags[name] = _text(body)[0]
            at += 10 + length
    return tags, start


def read_old_tag(data: bytes, at: int) -> dict[str, str] | None:
    """ID3v1, if just that is left at ``at``."""
    if len(data) - at != 128 or data[at : at + 3] != b"TAG":
        return None
    found = {}
    for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
        if value := data[at + a : at + b].split(b"\0")[0].decode("latin-1").strip():
            found[name] = value
    return found


@dataclass
class Stream:
    first: Header | None = None
    frames: int = 0
    samples: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0
    variable: bool = False
    table_frames: int | None = None
    table_bytes: int | None = None
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    payload: bytes = b""


def read_table(data: bytes, at: int, head: Header) -> tuple[bool, int | None, int | None] | None:
    """A Xing, Info or VBRI table in the frame at ``at``: variable?, frames, bytes."""
    spot = at + 4 + 2 * head.protected + head.side
    mark = data[spot : spot + 4]
    if mark in (b"Xing", b"Info") and spot + 16 <= len(data):
        flags, spot, found = int.from_bytes(data[spot + 4 : spot + 8], "big"), spot + 8, [None, None]
        for bit in (0, 1):
            if flags >> bit & 1:
                found[bit], spot = int.from_bytes(data[spot : spot + 4], "big"), spot + 4
        return mark == b"Xing", found[0], found[1]
    if data[at + 36 : at + 40] == b"VBRI" and at + 54 <= len(data):
        return True, int.from_bytes(data[at + 50 : at + 54], "big"), int.from_bytes(data[at + 46 : at + 50], "big")
    return None


def _stands(data: bytes, at: int) -> bool:
    """Whether a frame, an old tag or the end can be at ``at``."""
    return at + 4 > len(data) or header(data[at : at + 4]) is not None or read_old_tag(data, at) is not None


def _checks(data: bytes, at: int, head: Header) -> bool:
    """Whether the frame at ``at`` has a checksum that holds."""
    if not head.protected or head.layer != 3:
        return False
    covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + head.side]
    return crc16(covered) == int.from_bytes(data[at + 4 : at + 6], "big")


def parse(data: bytes | None) -> Stream:
    data = bytes(data or b"")
    out = Stream()
    out.tags, at = read_tags(data)
    end = len(data)
    body: list[bytes] = []
    rates = set()
    while at + 4 <= end:
        if (old := read_old_tag(data, at)) is not None:
            out.tags, at = old | out.tags, end
            break
        head = header(data[at : at + 4])
        follows = at + head.size if head else 0
        if head and out.first and (head.version, head.layer, head.frequency) != (
            out.first.version,
            out.first.layer,
            out.first.frequency,
        ):
            head = None
        if head is None or follows > end or not (_stands(data, follows) or _checks(data, at, head)):
            # Lost: the next 0xFF is the next place where a header can be.
            found = data.find(b"\xff", at + 1, end)
            out.skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        if not out.first and (table := read_table(data, at, head)):
            out.first = head
            out.variable, out.table_frames, out.table_bytes = table
            at = follows
            continue
        out.first = out.first or head
        rates.add(head.bitrate)
        if head.protected and head.layer == 3:
            good = _checks(data, at, head)
            out.crc_ok += good
            out.crc_bad += not good
        out.offsets.append(at)
        out.frames += 1
        out.samples += head.samples
        if head.layer == 3:
            body.append(data[at + 4 + 2 * head.protected + head.side : follows])
        at = follows
    out.skipped += max(0, end - at)
    out.variable |= len(rates) > 1
    length = out.tags.get(LENGTH_TAG, "")
    if length.isascii() and length.isdigit():
        out.payload = b"".join(body)[: int(length)]
    return out


_SIDE = 17  # of MPEG 1, mono
_OVERHEAD = 4 + 2 + _SIDE


@lru_cache(maxsize=32)
def _frame_start(index: int) -> tuple[bytes, int]:
    """Header, CRC and silent side information at a bitrate index (32 kHz, mono), and the room behind."""
    head = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 0xC0])
    side = bytes(_SIDE)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side, header(head).size - _OVERHEAD


def _pick(n: int) -> int:
    """The smallest bitrate index whose frame takes n bytes, or the largest of all."""
    return next((i for i in range(1, 15) if _frame_start(i)[1] >= n), 14)


def carry(payload: bytes) -> bytes:
    """The payload as an MPEG-1 Layer III file with an ID3v2.4 tag and a Xing table."""
    frames = []
    full = _frame_start(14)[1]
    for a in range(0, len(payload), full):
        part = payload[a : a + full]
        start, room = _frame_start(_pick(len(part)))
        frames.append(start + part + bytes(room - len(part)))
    body = f"{LENGTH_TAG}\0{len(payload)}".encode()
    text = b"TXXX" + (len(body) + 1).to_bytes(4, "big") + b"\0\0\x03" + body
    if len(body) + 1 > 127:
        raise ValueError("length tag too long")
    size = len(text)
    tag = b"ID3\x04\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + text
    total = sum(map(len, frames))
    seek, done, at = bytearray(100), 0, 0
    for percent in range(100):
        while at < len(frames) and at * 100 < percent * len(frames):
            done, at = done + len(frames[at]), at + 1
        seek[percent] = min(255, done * 256 // total) if total else 0
    start, room = _frame_start(_pick(4 + 4 + 4 + 4 + 100 + 4))
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(seek)
    return tag + start + table.ljust(room, b"\0") + b"".join(frames)


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def _store(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: carry(padded(bytes(x) if x is not None else b"")))


def _load(media: pd.Series) -> pd.DataFrame:
    def row(data: bytes) -> tuple:
        s = parse(data)
        head = s.first
        return (
            {3: "1", 2: "2", 0: "2.5"}[head.version] if head else None,
            head.layer if head else None,
            head.frequency if head else None,
            head.channels if head else None,
            s.frames,
            s.samples,
            s.samples / head.frequency if head else 0.0,
            s.variable,
            s.table_frames,
            s.table_bytes,
            s.crc_ok,
            s.crc_bad,
            s.skipped,
            s.tags,
            s.offsets,
            s.payload,
        )

    names = [part.strip().split(" ")[0] for part in SCHEMA.replace("map<string,string>", "map").split(",")]
    return pd.DataFrame([row(x) for x in media], columns=names).astype(
        {"layer": "Int32", "frequency": "Int32", "channels": "Int32", "table_frames": "Int64", "table_bytes": "Int64"}
    )


def store_text(text: Column) -> Column:
    """The text's bytes as MPEG audio (null: empty)."""
    return F.pandas_udf(_store, "binary")(text.cast("binary"))


def load_media(media: Column) -> Column:
    """What ``parse`` finds, as a struct of SCHEMA."""
    return F.pandas_udf(_load, SCHEMA)(media)


def with_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Append the stored form; a column of that name is replaced."""
    return docs.withColumn(media_col, store_text(F.col(text_col)))

