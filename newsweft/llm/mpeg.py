"""MPEG audio columns: frame resynchronisation, tags, bit-rate tables, checksums, exact durations and seek offsets."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), Hz by version bits.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ (0x8005 if value & 0x8000 else 0)
        table.append(value & 0xFFFF)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, all ones at the start."""
    value = 0xFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFF) ^ _CRC[(value >> 8) ^ byte]
    return value


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    checked: bool
    kbps: int
    rate: int
    mono: bool
    joint_bound: int
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def guarded(self) -> int | None:
        """Bytes after header and checksum that the checksum covers; None where it takes decoding to tell (layer II)."""
        if self.layer == 3:
            return self.side
        if self.layer == 1:
            return 16 if self.mono else (self.joint_bound * 8 + (32 - self.joint_bound) * 4) // 8
        return None


@lru_cache(maxsize=4096)
def parse_header(raw: bytes) -> Header | None:
    """The header in four bytes, or None: reserved values and free format count as no header."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    rate_index, speed = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or rate_index in (0, 15) or speed == 3 or raw[3] & 3 == 2:
        return None
    kbps, rate, padding = BITRATES[version == 3, layer][rate_index - 1], SAMPLE_RATES[version][speed], raw[2] >> 1 & 1
    if layer == 1:
        length, samples = (12000 * kbps // rate + padding) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        length = samples // 8 * 1000 * kbps // rate + padding
    mode = raw[3] >> 6
    bound = (raw[3] >> 4 & 3) * 4 + 4 if mode == 1 else 32
    return Header(version, layer, not raw[1] & 1, kbps, rate, mode == 3, bound, length, samples)


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    rate: int = 0
    version: str = ""
    layer: int = 0
    kbps: list[int] = field(default_factory=list)
    skipped: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    crc_unread: int = 0
    vbr_kind: str = ""
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    vbr_toc: bytes = b""
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)

    @property
    def duration(self) -> tuple[int, int]:
        """Seconds as a fraction in lowest terms; all frames share the first one's sample rate."""
        if not self.rate:
            return 0, 1
        shared = math.gcd(self.samples, self.rate) or 1
        return self.samples // shared, self.rate // shared


def _id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """(bytes that the tag takes, its text frames)."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(b & 0x80 for b in data[at + 6 : at + 10]):
        return 0, {}
    syncsafe = lambda raw: raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]
    major, size = data[at + 3], syncsafe(data[at + 6 : at + 10])
    end, here, found = min(len(data), at + 10 + size), at + 10, {}
    while major in (3, 4) and here + 10 <= end and data[here] != 0:
        raw = data[here + 4 : here + 8]
        n = syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        name, body = data[here : here + 4].decode("latin-1"), data[here + 10 : min(end, here + 10 + n)]
        if name.startswith("T") and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            found[name] = body[1:].decode(coding, "replace").rstrip("\0")
        here += 10 + n
    return 10 + size + (10 if data[at + 5] & 0x10 else 0), found


def _rate_table(data: bytes, at: int, head: Header) -> tuple[str, int | None, int | None, bytes] | None:
    """A Xing, Info or VBRI table in the frame at ``at``."""
    start = at + 4 + head.side
    for here in (start, start + 2):
        if (kind := data[here : here + 4]) in (b"Xing", b"Info"):
            flags, here = int.from_bytes(data[here + 4 : here + 8], "big"), here + 8
            values: list[int | None] = [None, None]
            for k in (0, 1):
                if flags >> k & 1:
                    values[k], here = int.from_bytes(data[here : here + 4], "big"), here + 4
            return kind.decode(), values[0], values[1], data[here : here + 100] if flags & 4 else b""
    if data[at + 36 : at + 40] == b"VBRI":
        return "VBRI", int.from_bytes(data[at + 50 : at + 54], "big"), int.from_bytes(data[at + 46 : at + 50], "big"), b""
    return None


def read(data: bytes | None) -> Stream:
    """What an MPEG audio stream holds; bytes that belong to no frame are skipped one by one and counted.

    A header starts a run of frames only when a second header of its kind follows at its length, or the stream ends
    there; after that each frame must continue at the last one's end. Null and empty input give no frames.
    """
    data, out = data or b"", Stream()
    taken, out.tags = _id3v2(data, 0)
    end = len(data)
    if end - taken >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        named = {"TIT2": data[end + 3 : end + 33], "TPE1": data[end + 33 : end + 63], "TALB": data[end + 63 : end + 93]}
        out.tags = {k: v.rstrip(b"\0 ").decode("latin-1") for k, v in named.items() if v.strip(b"\0 ")} | out.tags
    at, locked, first = taken, False, None
    while at + 4 <= end:
        head = parse_header(data[at : at + 4])
        good = head is not None and at + head.length <= end
        if good and first is not None:
            good = (head.version, head.layer, head.rate) == (first.version, first.layer, first.rate)
        if good and not locked and at + head.length + 4 <= end:
            after = parse_header(data[at + head.length : at + head.length + 4])
            good = after is not None and (after.version, after.layer, after.rate) == (head.version, head.layer, head.rate)
        if not good:
            step = data.find(b"\xff", at + 1, end)
            out.skipped += (step if step >= 0 else end) - at
            at, locked = step if step >= 0 else end, False
            continue
        table = _rate_table(data, at, head) if first is None and head.layer == 3 and not out.vbr_kind else None
        if table:
            out.vbr_kind, out.vbr_frames, out.vbr_bytes, out.vbr_toc = table
            at, locked = at + head.length, True
            continue
        if first is None:
            first = head
            out.rate, out.version, out.layer = head.rate, VERSIONS[head.version], head.layer
        if head.checked:
            if head.guarded is None:
                out.crc_unread += 1
            else:
                want = int.from_bytes(data[at + 4 : at + 6], "big")
                have = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + head.guarded])
                out.crc_good, out.crc_bad = out.crc_good + (want == have), out.crc_bad + (want != have)
        out.offsets.append(at)
        if head.kbps not in out.kbps:
            out.kbps.append(head.kbps)
        out.frames, out.samples = out.frames + 1, out.samples + head.samples
        at, locked = at + head.length, True
    out.skipped += max(0, end - at)
    return out


def seek(stream: Stream, seconds_num: int, seconds_den: int = 1) -> int | None:
    """Byte offset of the frame that sounds at an exact time."""
    if not stream.frames:
        return None
    per = stream.samples // stream.frames
    return stream.offsets[min(stream.frames - 1, max(0, seconds_num * stream.rate // (seconds_den * per)))]


#: A silent MPEG-2 layer III frame, 16 kHz, 144 kbit/s, mono, with checksum: 576 samples in 648 bytes.
UNIT, FRAME, _LEAD = 576, 648, 15
_PLAIN, _CHECKED = bytes((0xFF, 0xF3, 0xD8, 0xC0)), bytes((0xFF, 0xF2, 0xD8, 0xC0))


def pad(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of 576."""
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def store(payload: bytes) -> bytes:
    """An MPEG audio stream whose frames carry ``payload`` as ancillary data, 576 bytes each, after tag and table."""
    n = len(payload) // UNIT
    frames = np.zeros((n, FRAME), np.uint8)
    lead = _CHECKED + crc16(_CHECKED[2:] + bytes(9)).to_bytes(2, "big") + bytes(9)
    frames[:, :_LEAD] = np.frombuffer(lead, np.uint8)
    frames[:, _LEAD : _LEAD + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    title = b"TIT2" + (8).to_bytes(4, "big") + bytes(2) + b"\x03payload"
    tag = b"ID3\x04\x00\x00" + len(title).to_bytes(4, "big") + title
    size = (n + 1) * FRAME
    toc = bytes(min(255, 256 * (FRAME + n * i // 100 * FRAME) // size) for i in range(100))
    info = _PLAIN + bytes(9) + b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + size.to_bytes(4, "big") + toc
    tail = b"TAG" + b"payload".ljust(124, b"\0") + b"\xff"  # so that no payload is taken for the old tag at a file's end
    return tag + info + bytes(FRAME - len(info)) + frames.tobytes() + tail


def stored_payload(media: bytes, stream: Stream) -> bytes:
    """The payload of ``store`` read back from the frames that the parser found."""
    if not stream.offsets:
        return b""
    first, step = stream.offsets[0], FRAME
    if stream.offsets[-1] - first == (stream.frames - 1) * step:
        whole = np.frombuffer(media, np.uint8, stream.frames * step, first).reshape(-1, step)
        return whole[:, _LEAD : _LEAD + UNIT].tobytes()
    return b"".join(media[at + _LEAD : at + _LEAD + UNIT] for at in stream.offsets)


def feature(stream: Stream) -> str:
    """One line on a stream, for comparison: format, exact duration, checks and a digest of the seek offsets."""
    num, den = stream.duration
    marks = hashlib.sha256(np.array(stream.offsets, "<i8").tobytes()).hexdigest()[:16]
    return (
        f"mpeg{stream.version}/layer{stream.layer} {stream.rate}Hz {'+'.join(map(str, stream.kbps))}kbps frames={stream.frames} "
        f"duration={num}/{den} crc={stream.crc_good}:{stream.crc_bad} skipped={stream.skipped} "
        f"table={stream.vbr_kind}:{stream.vbr_frames}:{stream.vbr_bytes} seek={marks}"
    )


_READ = (
    "mpeg_version string, mpeg_layer int, sample_rate int, kbps array<int>, frames bigint, samples bigint, duration_num bigint, duration_den bigint, "
    "skipped_bytes bigint, crc_good bigint, crc_bad bigint, crc_unread bigint, vbr_kind string, vbr_frames bigint, vbr_bytes bigint, "
    "tags map<string,string>, seek_offsets array<bigint>"
)


def read_column(df: DataFrame, key: str, media: str) -> DataFrame:
    """``key`` and what each stream in the binary column ``media`` holds; a null stream has no frames."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                s = read(raw.as_py())
                rows.append((s.version, s.layer, s.rate, s.kbps, s.frames, s.samples, *s.duration, s.skipped, s.crc_good, s.crc_bad, s.crc_unread, s.vbr_kind, s.vbr_frames, s.vbr_bytes, list(s.tags.items()), s.offsets))
            cols = list(zip(*rows)) if rows else [[] for _ in _KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, _KINDS))], [key, *_NAMES])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, media).mapInArrow(step, f"`{key}` {kind}, {_READ}")


_NAMES = [x.split()[0] for x in _READ.split(", ")]
_KINDS = [
    {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string())}[x.split()[1]]
    for x in _READ.split(", ")
]

_DIGEST = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, frames bigint, duration_num bigint, duration_den bigint"


def digest(text: str | None) -> tuple:
    """The round trip of one text, null as empty, through ``store`` and ``read``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    media = store(pad(raw))
    found = read(media)
    back = stored_payload(media, found)
    return (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), found.frames, *found.duration)


def text_round_trips(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``digest`` of each row's whole text beside its id; repeated rows and null ids are kept, other columns not read."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last, value = [], object(), ()
            for cell in batch.column(1):
                now = cell.as_py() or ""
                if now != last:
                    last, value = now, digest(now)
                rows.append(value)
            names = [x.split()[0] for x in _DIGEST.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _DIGEST.split(", ")]
            cols = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds))], ["doc_id", *names])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(step, f"doc_id {kind}, {_DIGEST}")
