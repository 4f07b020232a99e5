"""Operator 8: MPEG audio columns.

``parse`` reads any MPEG audio byte string: it skips and reads ID3 tags,
resynchronises on frame headers (a header counts when the next one follows
where it says, or the stream ends there), walks the frames, verifies 16-bit
checksums where frames carry them, reads Xing/Info tables, and gives exact
durations (samples over sampling rate) and the byte offset of each frame.

``store`` puts a payload into such a stream without loss: silent Layer III
frames whose main data holds the payload's bytes, a table frame in front and
the payload's length in a tag. Rows are independent: no shuffle, and memory is
bounded by one Arrow batch and the largest row.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from obspark.llm import common

# Bit rates (kbit/s) by version class and layer, and sampling rates (Hz), of MPEG audio.
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLING = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

BLOCK = 64
SYNC = re.compile(rb"\xff[\xe2-\xff]")
#: Of the frames that ``store`` writes: MPEG-1 Layer III, 32 kHz, mono, with checksum.
SIDE = bytes(17)
FRAME_SIZES = tuple(144 * r // 32 for r in RATES[1, 3][1:])


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    rate: int
    sampling: int
    mono: bool
    checked: bool
    size: int
    samples: int
    side: int


@functools.lru_cache(4096)
def header(b: bytes) -> Header | None:
    """The frame header in four bytes, or None if they are none (free-format rates are not read)."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(b[1] >> 3 & 3)
    layer = 4 - (b[1] >> 1 & 3)
    r, s, pad = b[2] >> 4, b[2] >> 2 & 3, b[2] >> 1 & 1
    if version is None or layer == 4 or r in (0, 15) or s == 3:
        return None
    rate, sampling, mono = RATES[1 if version == 1 else 2, layer][r], SAMPLING[version][s], b[3] >> 6 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12_000 * rate // sampling + pad) * 4 if layer == 1 else samples // 8 * 1000 * rate // sampling + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(version, layer, rate, sampling, mono, not b[1] & 1, size, samples, side)


@functools.lru_cache(65536)
def checksum(protected: bytes) -> int:
    """16-bit checksum (polynomial 0x8005, all ones at first) of what a frame protects."""
    crc = 0xFFFF
    for byte in protected:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


@dataclass
class Audio:
    """What a stream holds."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    first: Header | None = None
    samples: int = 0
    rates: set[int] = field(default_factory=set)
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    table: dict[str, int] | None = None
    seek_table: bytes = b""

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.first.sampling if self.first else 0

    @property
    def kind(self) -> str:
        return f"mpeg{self.first.version:g}-layer{self.first.layer}" if self.first else "none"


def tags_of(data: bytes) -> tuple[dict[str, str], int, int]:
    """ID3 tags, and where the frames may begin and end."""
    tags, begin, end = {}, 0, len(data)
    while data[begin : begin + 3] == b"ID3" and len(data) >= begin + 10:
        major, stop = data[begin + 3], min(len(data), begin + 10 + unsafe(data[begin + 6 : begin + 10]))
        at = begin + 10
        while at + 10 <= stop and data[at : at + 4].isalnum():
            raw = data[at + 4 : at + 8]
            n = unsafe(raw) if major >= 4 else int.from_bytes(raw, "big")
            name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(stop, at + 10 + n)]
            if name[0] == "T" and body:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                text = body[1:].decode(code, "replace").rstrip("\0")
                key, _, value = text.rpartition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value
            at += 10 + n
        begin = stop
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(key, value)
    return tags, begin, end


def resync(data: bytes, at: int, end: int) -> int:
    """The first header from ``at`` that another of its kind, or the end, follows; ``end`` if none."""
    while m := SYNC.search(data, at, end):
        at = m.start()
        if (h := header(data[at : at + 4])) and at + h.size <= end:
            nxt = header(data[at + h.size : at + h.size + 4])
            if at + h.size == end or nxt and (nxt.version, nxt.layer, nxt.sampling) == (h.version, h.layer, h.sampling):
                return at
        at += 1
    return end


def parse(data: bytes | None) -> Audio:
    """Reads a whole stream; null or empty bytes, or bytes without a frame, give an empty result."""
    out = Audio()
    data = data or b""
    out.tags, at, end = tags_of(data)
    while at < end:
        h = header(data[at : at + 4])
        if h is None or at + h.size > end or out.first and (h.version, h.layer, h.sampling) != (out.first.version, out.first.layer, out.first.sampling):
            to = resync(data, at + (h is not None), end)
            out.skipped += to - at
            at = to
            continue
        body = at + 4 + 2 * h.checked
        if not out.offsets and out.table is None and data[at + 4 + h.side : at + 8 + h.side] in (b"Xing", b"Info"):
            p = at + 8 + h.side
            flags, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            out.table = {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out.table[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                out.seek_table = data[p : p + 100]
        else:
            if h.checked and h.layer == 3:
                out.checked += 1
                out.failed += checksum(data[at + 2 : at + 4] + data[body : body + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big")
            out.offsets.append(at)
            out.samples += h.samples
            out.rates.add(h.rate)
            out.first = out.first or h
        at += h.size
    return out


@functools.lru_cache(32)
def lead(index: int) -> bytes:
    """Header, checksum and side information of a written frame of bit rate ``index``."""
    h = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC4))
    return h + checksum(h[2:] + SIDE).to_bytes(2, "big") + SIDE


LEAD = 4 + 2 + len(SIDE)


def store(payload: bytes) -> bytes:
    """The payload in silent frames, the fewest bytes for the last one, behind a tag and a table frame."""
    room = FRAME_SIZES[-1] - LEAD
    whole, rest = divmod(len(payload), room)
    frames = [lead(14) + payload[i * room : (i + 1) * room] for i in range(whole)]
    if rest:
        k = next(i for i, s in enumerate(FRAME_SIZES) if s - LEAD >= rest)
        frames.append((lead(k + 1) + payload[whole * room :]).ljust(FRAME_SIZES[k], b"\0"))
    audio = b"".join(frames)
    total = FRAME_SIZES[3] + len(audio)
    # frames last equally long: the i-th hundredth of the time starts with frame i * n // 100
    toc = bytes(min(255, 256 * (FRAME_SIZES[3] + i * len(frames) // 100 * FRAME_SIZES[-1]) // total) for i in range(100))
    table = bytes((0xFF, 0xFB, 4 << 4 | 2 << 2, 0xC4)) + SIDE + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + syncsafe(len(tag)) + tag + table.ljust(FRAME_SIZES[3], b"\0") + audio


def restore(data: bytes, audio: Audio) -> bytes:
    """The payload that ``store`` put into a stream."""
    view = memoryview(data)
    parts = [view[at + LEAD : at + header(data[at : at + 4]).size] for at in audio.offsets]
    return b"".join(parts)[: int(audio.tags.get("payload_bytes", "0"))]


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text up to a positive multiple of 64, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0"), len(raw)


def feature(a: Audio) -> str:
    seeks = np.array(a.offsets, "<i8").tobytes()
    return f"{a.kind};{a.first.sampling if a.first else 0}Hz;frames={len(a.offsets)};samples={a.samples};duration_us={a.duration_us};variable={int(a.table is not None)};rates={'/'.join(map(str, sorted(a.rates)))};checked={a.checked};failed={a.failed};skipped={a.skipped};seek_crc32={zlib.crc32(seeks)}"


READ = "doc_id long, kind string, sampling_hz int, samples long, duration_us long, frames long, checked long, failed long, skipped long, tags map<string,string>, seek_offsets array<long>"


def read_audio(frame: DataFrame) -> DataFrame:
    """Durations, checks, tags and seek offsets of the streams of a table (doc_id, media; others are ignored).

    A null or empty stream, and one without a frame, has the kind ``none`` and
    zeros; repeated rows each give a row; an empty table gives none.
    """

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 6, pa.map_(pa.string(), pa.string()), pa.list_(pa.int64())]
        for ids, media in common.batches(frames, "doc_id", "media"):
            rows = [(i, a.kind, a.first.sampling if a.first else None, a.samples, a.duration_us, len(a.offsets), a.checked, a.failed, a.skipped, list(a.tags.items()), a.offsets) for i, a in zip(ids, map(parse, media), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in READ.split(", ")])

    return frame.select("doc_id", "media").mapInArrow(task, READ)


STORED = "doc_id long, n_bytes long, media binary"


def store_texts(docs: DataFrame) -> DataFrame:
    """A media column (doc_id, n_bytes, media) with the padded texts of ``docs`` (doc_id, text; others are ignored).

    A null text counts as empty, which is one block of zeros; texts of any
    length are stored whole; equal texts, and so repeated rows, give equal
    streams, a row each. An empty table gives no rows.
    """

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.batches(frames, "doc_id", "text"):
            done = [(n, store(p)) for p, n in map(padded, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([n for n, _ in done], pa.int64()), pa.array([m for _, m in done], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(task, STORED)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """Reads stored streams (doc_id, n_bytes, media; others are ignored) back: payload, checks and features of each.

    A null stream has an empty payload; repeated rows each give a row; an empty
    table gives none.
    """

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for ids, sizes, streams in common.batches(frames, "doc_id", "n_bytes", "media"):
            rows = []
            for i, n, m in zip(ids, sizes, streams, strict=True):
                a = parse(m)
                p = restore(m, a)
                rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature(a)))
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(task, DIGEST)


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as MPEG audio and read back."""
    return digests(store_texts(common.documents(spark, sf_dir)))
