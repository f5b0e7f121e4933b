"""MPEG audio as a media column: writing, resynchronising, reading and indexing.

``parse`` reads any MPEG 1, 2 or 2.5 stream of layers I to III: ID3v2 and ID3v1 tags,
Xing/Info and VBRI tables, frames found by their headers (a header counts if the next
one stands where it says, or the stream ends there), checksums of layer III, and the
exact duration in samples with the byte offset of every frame.

``carry`` stores bytes losslessly in such a stream: frames of silence (layer III, all
side information zero) hold them as ancillary data; an ID3v2 tag gives their number and
an Xing table the frames, bytes and seek points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, fresh

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by version and layer, sampling rates in Hz, samples a frame.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information of layer III."""
        return (17 if self.mono else 32) if self.version == "1" else (9 if self.mono else 17)

    @property
    def body(self) -> int:
        """Where a frame's data begins."""
        return 4 + 2 * self.protected + (self.side if self.layer == 3 else 0)


@lru_cache(maxsize=1 << 16)
def header(four: bytes) -> Header | None:
    """A frame header, or None if the four bytes are none (or of free format, which has no length)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    kbits_at, rate_at, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version is None or layer == 4 or kbits_at in (0, 15) or rate_at == 3 or four[3] & 3 == 2:
        return None
    family = 1 if version == "1" else 2
    kbits, rate = KBITS[family, layer][kbits_at], RATES[version][rate_at]
    samples = SAMPLES[family, layer]
    size = (12000 * kbits // rate + pad) * 4 if layer == 1 else samples * 125 * kbits // rate + pad
    return Header(version, layer, not four[1] & 1, kbits, rate, four[3] >> 6 == 3, size, samples)


@lru_cache(maxsize=1 << 12)
def checksum(data: bytes) -> int:
    """CRC-16 of MPEG audio (polynomial 0x8005, start 0xFFFF)."""
    crc = 0xFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ byte >> bit) & 1 else 0)) & 0xFFFF
    return crc


@dataclass
class Index:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    frames: list[int] = field(default_factory=list)  # offsets of the audio frames
    bodies: list[tuple[int, int]] = field(default_factory=list)  # of each frame: begin and end of its data
    samples: int = 0
    rate: int = 0
    version: str = ""
    layer: int = 0
    mono: bool = False
    kbits: tuple[int, ...] = ()
    checked: int = 0
    broken: int = 0
    skipped: int = 0  # bytes that belong to no tag and no frame


def _synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads an ID3v2 tag at ``at``; where it ends (``at`` if there is none)."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at
    major, flags, size = data[at + 3], data[at + 5], _synchsafe(data[at + 6 : at + 10])
    end, p = min(len(data), at + 10 + size), at + 10
    if flags & 0x40 and major >= 3:
        p += _synchsafe(data[p : p + 4]) if major == 4 else int.from_bytes(data[p : p + 4], "big") + 4
    head = 6 if major == 2 else 10
    while p + head < end and data[p]:
        name = data[p : p + (3 if major == 2 else 4)].decode("latin-1")
        raw = data[p + 3 : p + 6] if major == 2 else data[p + 4 : p + 8]
        n = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        value = data[p + head : min(end, p + head + n)]
        p += head + n
        if name[0] == "T" and value:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
            text = value[1:].decode(code, "replace").rstrip("\0").split("\0", 1)
            if name in ("TXXX", "TXX") and len(text) == 2:
                tags[f"{name}:{text[0]}"] = text[1]
            else:
                tags[name] = text[0]
    return at + 10 + size + (10 if flags & 0x10 else 0)


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table in a frame, if it holds one."""
    p = at + h.body
    mark = data[p : p + 4]
    if mark in (b"Xing", b"Info"):
        flags, p, out = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8, {"kind": mark.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out["seek"], p = list(data[p : p + 100]), p + 100
        return out
    p = at + 36
    if data[p : p + 4] == b"VBRI" and len(data) >= p + 26:
        size, frames, entries, scale, width, step = struct.unpack(">IIHHHH", data[p + 10 : p + 26])
        seek = [int.from_bytes(data[p + 26 + k * width : p + 26 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "step": step, "seek": seek}
    return None


def parse(data: bytes | None) -> Index:
    """Index of a stream. Null, empty or foreign bytes give an index without frames; whatever is no frame is skipped."""
    data = data or b""
    out, at, end = Index(), 0, len(data)
    last = end - 128 if end >= 128 and data[-128:-125] == b"TAG" else end  # a tag only if no frame runs over it
    kbits, first = set(), True
    while at < end:
        if (after := _id3(data, at, out.tags)) > at:
            at = min(after, end)
            continue
        if at == last:
            out.tags["TAG"] = data[at + 3 : at + 33].split(b"\0")[0].decode("latin-1").rstrip()
            break
        h = header(data[at : at + 4])
        stop = at + h.size if h else 0
        follows = h and stop <= end and (stop in (last, end) or data[stop : stop + 3] == b"ID3" or (n := header(data[stop : stop + 4])) is not None and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate))
        if not follows:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            found = last if at < last < found else found
            if (tag := data.find(b"ID3", at + 1, found)) >= 0:
                found = tag
            out.skipped += found - at
            at = found
            continue
        if h.protected and h.layer == 3:
            out.checked += 1
            out.broken += checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big")
        if first and (table := _table(data, at, h)) is not None:
            out.table = table
        else:
            out.frames.append(at)
            out.bodies.append((at + h.body, stop))
            out.samples += h.samples
            kbits.add(h.kbits)
        if first:
            out.version, out.layer, out.rate, out.mono, first = h.version, h.layer, h.rate, h.mono, False
        at = stop
    out.kbits = tuple(sorted(kbits))
    return out


@lru_cache(maxsize=64)
def _silence(kbits_at: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a frame of silence (MPEG 1 layer III, 44.1 kHz, mono), and the room after it."""
    head = bytes([0xFF, 0xFA, kbits_at << 4, 0xC0])
    h = header(head)
    side = bytes(h.side)
    return head + checksum(head[2:] + side).to_bytes(2, "big") + side, h.size - h.body


_ROOMS = [_silence(k)[1] for k in range(1, 15)]


def carry(payload: bytes) -> bytes:
    """A stream that holds the payload: whole frames of 320 kbit/s, and the smallest last one that has room."""
    front, room = _silence(14)
    whole = len(payload) // room
    frames = [front + payload[k * room : (k + 1) * room] for k in range(whole)]
    if rest := payload[whole * room :]:
        at = next(k for k, r in enumerate(_ROOMS) if r >= len(rest)) + 1
        head, space = _silence(at)
        frames.append(head + rest.ljust(space, b"\0"))
    head, space = _silence(5)
    size = len(head) + space + sum(map(len, frames))
    starts, at = [], len(head) + space
    for f in frames:
        starts.append(at)
        at += len(f)
    seek = bytes(min(255, 256 * starts[min(len(frames) - 1, p * len(frames) // 100)] // size) if frames else 0 for p in range(100))
    info = head + (b"Xing" + struct.pack(">III", 7, len(frames), size) + seek).ljust(space, b"\0")
    value = b"\3payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(value).to_bytes(4, "big") + b"\0\0" + value
    return b"ID3\4\0\0" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0)) + tag + info + b"".join(frames)


def payload(data: bytes, index: Index | None = None) -> bytes:
    """The bytes that ``carry`` stored."""
    index = index or parse(data)
    return b"".join(data[a:b] for a, b in index.bodies)[: int(index.tags["TXXX:payload_bytes"])]


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def stored_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): every row's text as a stream; null as empty."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for low in range(0, len(texts), 256):
                part = texts[low : low + 256]
                sizes = pa.array([len((t or "").encode()) for t in part], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, len(part)), sizes, pa.array([carry(padded(t)) for t in part], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


INDEX = "version string, layer int, rate int, mono boolean, kbits array<int>, n_frames long, samples long, duration_us long, seek array<long>, checked long, broken long, skipped long, tags map<string,string>"


def indexed(media: DataFrame, column: str = "media") -> DataFrame:
    """media with ``index`` (or, where media has such a column, index_): struct of header fields, exact duration and seek offsets. Null media: an index without frames."""
    bound_batches(media.sparkSession)
    name = fresh(media, "index")
    kind = pa.struct([
        ("version", pa.string()), ("layer", pa.int32()), ("rate", pa.int32()), ("mono", pa.bool_()), ("kbits", pa.list_(pa.int32())), ("n_frames", pa.int64()), ("samples", pa.int64()),
        ("duration_us", pa.int64()), ("seek", pa.list_(pa.int64())), ("checked", pa.int64()), ("broken", pa.int64()), ("skipped", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())),
    ])

    def row(data: bytes | None) -> dict:
        x = parse(data)
        return {"version": x.version, "layer": x.layer, "rate": x.rate, "mono": x.mono, "kbits": x.kbits, "n_frames": len(x.frames), "samples": x.samples, "duration_us": x.samples * 1_000_000 // x.rate if x.rate else 0, "seek": x.frames, "checked": x.checked, "broken": x.broken, "skipped": x.skipped, "tags": list(x.tags.items())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([row(x) for x in b.column(at).to_pylist()], kind)], [*b.schema.names, name])

    return media.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema) + f", {name} struct<{', '.join(x.replace(' ', ': ', 1) for x in INDEX.split(', '))}>")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Texts stored as streams, read back and summed up: one row for each row of docs."""

    def feature(x: Index) -> str:
        table = x.table or {}
        seek = hashlib.sha256(struct.pack(f"<{len(x.frames)}Q", *x.frames)).hexdigest()[:16]
        return f"mpeg{x.version}-layer{x.layer}:{x.rate}:{'mono' if x.mono else 'stereo'}:kbits={'/'.join(map(str, x.kbits))}:frames={len(x.frames)}:samples={x.samples}:us={x.samples * 1_000_000 // x.rate if x.rate else 0}:table={table.get('kind')}/{table.get('frames')}/{table.get('bytes')}:crc={x.checked - x.broken}/{x.checked}:skipped={x.skipped}:seek={seek}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(2).to_pylist():
                x = parse(data)
                raw = payload(data, x)
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(x)))
            kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
            cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    media = stored_texts(docs, text, doc_id)
    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
