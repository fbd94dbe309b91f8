"""Operator 6: MPEG audio columns.

parse() resynchronises on frame headers, reads ID3v1, ID3v2 and the Xing, Info and VBRI tables, verifies the frames'
checksums and gives the exact duration and every frame's offset. carry() stores arbitrary bytes in a valid silent Layer
III stream: each 192-byte unit is the ancillary data of one protected frame whose granules are empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import common

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, Hz by index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
UNIT = 192


@dataclass(frozen=True)
class Header:
    version: str  # "1", "2" or "2.5"
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int  # bytes of Layer III side information

    @property
    def stream(self) -> tuple:
        """What all frames of a stream have in common."""
        return self.version, self.layer, self.rate


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """The header in four bytes, or None; free format (bitrate index 0) isn't supported."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    kind, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    rate_at, bit_at = raw[2] >> 2 & 3, raw[2] >> 4
    if kind == 1 or layer == 4 or rate_at == 3 or bit_at in (0, 15) or raw[3] & 3 == 2:
        return None
    first, mono, pad = kind == 3, raw[3] >> 6 == 3, raw[2] >> 1 & 1
    bitrate, rate = BITRATES[1 if first else 2, layer][bit_at] * 1000, RATES[kind][rate_at]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate // rate + pad
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header({3: "1", 2: "2", 0: "2.5"}[kind], layer, not raw[1] & 1, bitrate, rate, mono, size, samples, side)


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """CRC-16 of the standard: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # of audio frames
    samples: int = 0
    rate: int = 0
    bitrates: set[int] = field(default_factory=set)
    checked: int = 0  # Layer III frames with a checksum
    bad: int = 0
    skipped: int = 0  # bytes passed over to find a header again
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, object] = field(default_factory=dict)
    kind: str = ""

    @property
    def duration(self) -> Fraction:
        return Fraction(self.samples, self.rate) if self.rate else Fraction(0)


def _synchsafe(raw: bytes) -> int:
    n = 0
    for b in raw:
        n = n << 7 | b & 0x7F
    return n


def _id3v2(data: bytes, out: Stream) -> int:
    """Reads the tag at the start; its length."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end = min(len(data), 10 + _synchsafe(data[6:10]))
    at, four = 10, data[3] >= 4
    while at + 10 <= end and data[at : at + 4].isalnum():
        n = _synchsafe(data[at + 4 : at + 8]) if four else int.from_bytes(data[at + 4 : at + 8], "big")
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(end, at + 10 + n)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
            key, _, value = text.partition("\0")
            out.tags[f"{name}:{key}" if name == "TXXX" else name] = value if name == "TXXX" else text
        at += 10 + n
    return end + 10 * bool(data[5] & 0x10)


def _vbr(frame: bytes, h: Header) -> dict[str, object]:
    """The table of a Xing, Info or VBRI frame, or {}."""
    at = 4 + 2 * h.protected + h.side
    name = frame[at : at + 4]
    if name in (b"Xing", b"Info"):
        out, flags, at = {"kind": name.decode()}, int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        for bit, key, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[key] = list(frame[at : at + n]) if key == "toc" else int.from_bytes(frame[at : at + n], "big")
                at += n
        return out
    if frame[36:40] == b"VBRI":
        num = lambda a, n: int.from_bytes(frame[a : a + n], "big")
        count, scale, width, per = num(54, 2), num(56, 2), num(58, 2), num(60, 2)
        table = [num(62 + i * width, width) * scale for i in range(count)]
        return {"kind": "VBRI", "bytes": num(46, 4), "frames": num(50, 4), "toc": table, "frames_per_entry": per}
    return {}


def parse(data: bytes | None) -> Stream:
    """Never fails: bytes that are no frame are counted in `skipped`; a cut last frame isn't counted as one.

    A header is trusted when the next frame's header belongs to the same stream, or the data (or an ID3v1 tag) ends there.
    Checksums of Layer I and II frames aren't verified.
    """
    out = Stream()
    if not data:
        return out
    at, end = _id3v2(data, out), len(data)
    if end >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        for key, a, n in (("title", 3, 30), ("artist", 33, 30), ("album", 63, 30), ("year", 93, 4)):
            out.tags.setdefault(f"id3v1:{key}", data[end + a : end + a + n].split(b"\0")[0].decode("latin-1").strip())
    stream, in_step = None, False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and at + h.size <= end and (stream is None or h.stream == stream):
            after = at + h.size
            following = header(data[after : after + 4]) if after + 4 <= end else None
            if in_step or after == end or following and following.stream == h.stream:
                frame = data[at:after]
                if h.layer == 3 and h.protected:
                    out.checked += 1
                    out.bad += crc16(frame[2:4] + frame[6 : 6 + h.side]) != int.from_bytes(frame[4:6], "big")
                table = _vbr(frame, h) if stream is None else {}
                if table:
                    out.vbr = table
                else:
                    out.offsets.append(at)
                    out.samples += h.samples
                    out.bitrates.add(h.bitrate)
                stream, in_step, at = h.stream, True, after
                out.kind, out.rate = f"mpeg{h.version}.layer{h.layer}", h.rate
                continue
        in_step = False
        found = data.find(b"\xff", at + 1, end)
        found = end if found < 0 else found
        out.skipped += found - at
        at = found
    out.skipped += max(0, end - at)
    return out


# Layer III, MPEG-1, protected, 80 kbit/s, 48 kHz, mono: 240 bytes a frame, 23 before the ancillary data.
HEAD = bytes((0xFF, 0xFA, 0x64, 0xC0))
FRAME, LEAD = 240, 23
START = HEAD + crc16(HEAD[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)
FILL = bytes(FRAME - LEAD - UNIT)


def padded(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of UNIT."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def carry(payload: bytes, n_bytes: int) -> bytes:
    """The MPEG stream that holds `payload` (a positive multiple of UNIT); n_bytes, its unpadded length, is a tag."""
    text = b"\x03n_bytes\0" + str(n_bytes).encode()
    body = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    if len(text) > 127:
        raise ValueError("tag too long")
    tag = b"ID3\x04\0\0" + bytes(len(body) >> s & 0x7F for s in (21, 14, 7, 0)) + body
    n = len(payload) // UNIT
    size = (n + 1) * FRAME
    toc = bytes((FRAME + n * i // 100 * FRAME) * 256 // size for i in range(100))
    info = START + b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + size.to_bytes(4, "big") + toc
    frames = (part for i in range(n) for part in (START, payload[i * UNIT : (i + 1) * UNIT], FILL))
    return tag + info.ljust(FRAME, b"\0") + b"".join(frames)


def payload_of(data: bytes, stream: Stream) -> bytes:
    """What carry() stored."""
    return b"".join([data[a + LEAD : a + LEAD + UNIT] for a in stream.offsets])


def feature(s: Stream) -> str:
    """Kind, duration in seconds as a fraction, frames, checksums, table and a checksum of all seek offsets."""
    seek = zlib.crc32(b"".join(a.to_bytes(8, "little") for a in s.offsets))
    rates = "+".join(str(b // 1000) for b in sorted(s.bitrates))
    return f"{s.kind};hz={s.rate};kbps={rates};frames={len(s.offsets)};seconds={s.duration};crc={s.checked - s.bad}/{s.checked};skipped={s.skipped};vbr={s.vbr.get('kind', '')}:{s.vbr.get('frames', '')};seek={seek:08x}"


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as an MPEG stream, in a table of the shared folder.

    Null text is empty (one frame of spaces); null doc_ids and repeated rows stay; other columns are ignored.
    """

    @F.pandas_udf("n_bytes long, media binary")
    def store(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            raw = [(t or "").encode("utf-8") for t in texts]
            yield pd.DataFrame({"n_bytes": [len(x) for x in raw], "media": [carry(padded(x), len(x)) for x in raw]})

    out = docs.select("doc_id", store("text").alias("_m")).select("doc_id", "_m.n_bytes", "_m.media")
    path = common.scratch(docs.sparkSession, "media")
    out.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def media_features(media: DataFrame) -> DataFrame:
    """Adds to each row of `media` (binary column media): duration, offsets, tags and the digests of the stored bytes."""
    schema = "samples long, rate int, frame_offsets array<long>, checked int, bad int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    @F.pandas_udf(schema)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            rows = []
            for data in column:
                data = bytes(data or b"")
                s = parse(data)
                p = payload_of(data, s)
                rows.append((s.samples, s.rate, s.offsets, s.checked, s.bad, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(s)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return media.withColumn("_f", look("media")).select(*[c for c in media.columns if c != "media"], "_f.*")


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_features(media_table(common.table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
