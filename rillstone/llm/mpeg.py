"""MPEG audio columns: write payloads as frames, read frames back, exact durations and seek offsets.

A stream is an ID3v2 tag, a frame that holds the table of variable bitrates, and Layer III frames with
checksums, whose main data carry the payload in units of 192 bytes. The reader takes any stream of
Layer III frames of MPEG-1, 2 or 2.5, mono or stereo: it skips tags, resynchronises after junk, verifies
checksums, reads the table (Xing, Info or VBRI) and lists every frame. Free-format frames, whose headers
give no bitrate, count as junk.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch, slices

# Fixed values of the format: Layer III bitrates (kbit/s) by header index of MPEG-1 and of MPEG-2 and 2.5, sampling
# rates of MPEG-1 (half of them in MPEG-2, a quarter in 2.5), and the size of the side information.
BITRATES = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
LOW_BITRATES = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
RATES = [44100, 48000, 32000]
SIDE_BYTES = {"MPEG-1 mono": 17, "MPEG-1 stereo": 32, "MPEG-2 mono": 9, "MPEG-2 stereo": 17}
SAMPLES, LOW_SAMPLES = 1152, 576
UNIT = 192
HEADER, CRC, SIDE = 4, 2, 17  # a mono frame: header, checksum, side information, then main data
#: Bitrate index of frames of one unit and of two; at 48 kHz they have 240 and 480 bytes.
ONE, TWO = BITRATES.index(80), BITRATES.index(160)
_POLY = 0x8005


def _crc_table() -> np.ndarray:
    """CRC-16 of each byte, polynomial x^16 + x^15 + x^2 + 1, highest bit first."""
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, t << 1 ^ _POLY, t << 1) & 0xFFFF
    return t


_TABLE = _crc_table()


def checksums(rows: np.ndarray) -> np.ndarray:
    """The CRC-16 of each row of bytes, started at 0xFFFF."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        crc = (crc << 8 & 0xFFFF) ^ _TABLE[crc >> 8 ^ rows[:, k]]
    return crc


def _frames(units: np.ndarray, per_frame: int) -> np.ndarray:
    """Frames of ``per_frame`` units each, as rows of bytes."""
    index = ONE if per_frame == 1 else TWO
    size = 144 * BITRATES[index] * 1000 // RATES[1]
    out = np.zeros((len(units) // per_frame, size), np.uint8)
    # Sync, MPEG-1 Layer III, protected; bitrate and 48 kHz; mono.
    out[:, :HEADER] = [0xFF, 0xFA, index << 4 | 1 << 2, 0xC0]
    body = HEADER + CRC + SIDE
    out[:, HEADER + CRC] = per_frame  # first byte of the side information: units that follow
    out[:, body : body + UNIT * per_frame] = units.reshape(len(out), UNIT * per_frame)
    covered = np.concatenate([out[:, 2:HEADER], out[:, HEADER + CRC : body]], axis=1)
    crc = checksums(covered)
    out[:, HEADER], out[:, HEADER + 1] = crc >> 8, crc & 0xFF
    return out


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _tag(length: int) -> bytes:
    """An ID3v2.4 tag with the payload's unpadded length as user text."""
    text = b"\x03payload\x00" + str(length).encode()
    frame = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + _syncsafe(len(frame)) + frame


def _table_frame(frames: int, audio_bytes: int, toc: bytes) -> bytes:
    """A silent frame whose main data hold the table of variable bitrates: frames, bytes and 100 seek points."""
    size = 144 * BITRATES[TWO] * 1000 // RATES[1]
    head = bytes([0xFF, 0xFB, TWO << 4 | 1 << 2, 0xC0]) + bytes(SIDE)
    table = b"Xing" + (7).to_bytes(4, "big") + (frames + 1).to_bytes(4, "big") + (size + audio_bytes).to_bytes(4, "big") + toc
    return (head + table).ljust(size, b"\x00")


def _toc(sizes: np.ndarray, first: int) -> bytes:
    """For each hundredth of the duration the place of its frame, in 256ths of the bytes."""
    starts = first + np.concatenate([[0], np.cumsum(sizes)])[:-1]
    total = first + int(sizes.sum())
    frame = np.minimum(np.arange(100) * len(sizes) // 100, max(len(sizes) - 1, 0))
    return (starts[frame] * 256 // total).astype(np.uint8).tobytes() if len(sizes) else bytes(100)


def encode(payload: bytes, unpadded: int) -> bytes:
    """A payload of whole units as an MPEG audio stream of variable bitrate."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    pairs = len(units) // 2
    two, one = _frames(units[: 2 * pairs], 2), _frames(units[2 * pairs :], 1)
    sizes = np.array([two.shape[1]] * len(two) + [one.shape[1]] * len(one), np.int64)
    silent = 144 * BITRATES[TWO] * 1000 // RATES[1]
    return _tag(unpadded) + _table_frame(len(sizes), int(sizes.sum()), _toc(sizes, silent)) + two.tobytes() + one.tobytes()


def pad(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of a unit."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


@dataclass
class Stream:
    """What a stream holds: its tag's text, table, frame offsets and sizes, checksum errors and junk bytes."""

    length: int | None = None
    samples: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    rate: int = RATES[1]
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    bad: int = 0
    junk: int = 0
    payload: bytes = b""


@dataclass(frozen=True)
class Head:
    """What a frame's header tells."""

    size: int
    side: int
    samples: int
    rate: int
    guarded: bool

    @property
    def body(self) -> int:
        """Where the main data begin."""
        return HEADER + CRC * self.guarded + self.side


_heads: dict[bytes, Head | None] = {}  # by the three bytes after the first, of which streams have few


def _read_head(b: bytes) -> Head | None:
    version, index, rate = b[0] >> 3 & 3, b[1] >> 4, b[1] >> 2 & 3
    if b[0] & 0xE0 != 0xE0 or version == 1 or b[0] >> 1 & 3 != 1 or not 0 < index < 15 or rate == 3:
        return None
    first, mono = version == 3, b[2] >> 6 == 3
    per_second = RATES[rate] // {3: 1, 2: 2, 0: 4}[version]
    samples, kbits = (SAMPLES, BITRATES) if first else (LOW_SAMPLES, LOW_BITRATES)
    side = SIDE_BYTES[f"MPEG-{1 if first else 2} {'mono' if mono else 'stereo'}"]
    return Head(samples // 8 * 1000 * kbits[index] // per_second + (b[1] >> 1 & 1), side, samples, per_second, not b[0] & 1)


def _head(data: bytes, at: int) -> Head | None:
    """The header at ``at``; None if there is none."""
    if at + HEADER > len(data) or data[at] != 0xFF:
        return None
    key = data[at + 1 : at + HEADER]
    if key not in _heads:
        if len(_heads) > 4096:
            _heads.clear()
        _heads[key] = _read_head(key)
    return _heads[key]


def _covered(rows: np.ndarray, head: Head) -> np.ndarray:
    """The bytes of frames that their checksums cover: half of the header, and the side information."""
    return np.concatenate([rows[:, 2:HEADER], rows[:, HEADER + CRC : HEADER + CRC + head.side]], axis=1)


def _sound(data: bytes, at: int, head: Head) -> bool:
    """Whether the frame at ``at`` has a checksum that holds."""
    if not head.guarded or at + head.body > len(data):
        return False
    row = np.frombuffer(data, np.uint8, head.body, at)[None]
    return int(checksums(_covered(row, head))[0]) == int(row[0, HEADER]) << 8 | int(row[0, HEADER + 1])


def _tag_end(data: bytes, at: int) -> int:
    if data[at : at + 3] != b"ID3" or at + 10 > len(data):
        return at
    size = 0
    for b in data[at + 6 : at + 10]:
        size = size << 7 | b & 0x7F
    return min(len(data), at + 10 + size + (10 if data[at + 5] & 0x10 else 0))


def _tag_length(tag: bytes) -> int | None:
    at = tag.find(b"\x03payload\x00")
    text = tag[at + 9 :].rstrip(b"\x00") if at >= 0 else b""
    return int(text) if text.isdigit() and len(text) < 19 else None


def decode(data: bytes) -> Stream:
    """Read a stream back. A header counts if its whole frame is there and its checksum holds or the next
    header, the end of the stream or a tag follows; bytes before the next such place are junk."""
    out, at, headers = Stream(), _tag_end(data, 0), []
    out.length = _tag_length(data[:at])
    while at < len(data):
        head = _head(data, at)
        after = at + head.size if head else at
        if head and after <= len(data) and (after == len(data) or _head(data, after) or data[after : after + 3] in (b"TAG", b"ID3") or _sound(data, at, head)):
            headers.append((at, head))
            at = after
        elif data[at : at + 3] == b"TAG":
            at = min(len(data), at + 128)
        elif (end := _tag_end(data, at)) > at:
            at = end
        else:
            next_sync = data.find(b"\xff", at + 1)
            next_sync = len(data) if next_sync < 0 else next_sync
            out.junk += next_sync - at
            at = next_sync
    if headers:
        out.rate = headers[0][1].rate
        if _table(data, *headers[0], out):
            headers.pop(0)
    out.offsets, out.sizes, out.samples = [at for at, _ in headers], [h.size for _, h in headers], sum(h.samples for _, h in headers)
    out.bad, payload = _main_data(np.frombuffer(data, np.uint8), headers)
    out.payload = b"" if out.length is None else payload  # streams of others carry sound
    return out


def _table(data: bytes, at: int, head: Head, out: Stream) -> bool:
    """Read the table of variable bitrates into ``out`` if the frame at ``at`` holds one."""
    number = lambda place, n=4: int.from_bytes(data[place : place + n], "big")
    place = at + head.body
    if data[place : place + 4] in (b"Xing", b"Info"):
        flags, place = number(place + 4), place + 8
        if flags & 1:
            out.table_frames, place = number(place), place + 4
        if flags & 2:
            out.table_bytes, place = number(place), place + 4
        if flags & 4:
            out.toc = data[place : place + 100]
        return True
    place = at + HEADER + 32  # a VBRI table stands there whatever the side information
    if data[place : place + 4] == b"VBRI":
        out.table_bytes, out.table_frames = number(place + 10), number(place + 14)
        entries, scale, width = number(place + 18, 2), number(place + 20, 2), number(place + 22, 2)
        steps = [number(place + 26 + i * width, width) * scale for i in range(entries)] if 0 < width <= 4 else []
        total, so_far = max(sum(steps), 1), np.concatenate([[0], np.cumsum(steps)])
        out.toc = bytes(int(so_far[p * len(steps) // 100]) * 255 // total for p in range(100)) if steps else b""
        return True
    return False


def _main_data(raw: np.ndarray, headers: list[tuple[int, Head]]) -> tuple[int, bytes]:
    """Frames whose checksum fails, and the units of the others in order."""
    parts, bad = {}, 0
    kinds: dict[Head, list[int]] = {}
    for i, (_, head) in enumerate(headers):
        kinds.setdefault(head, []).append(i)
    for head, which in kinds.items():
        if not head.guarded:
            continue
        places = np.array([headers[i][0] for i in which])
        for lo in range(0, len(which), 4096):
            rows = raw[places[lo : lo + 4096, None] + np.arange(max(head.size, head.body)).clip(max=head.size - 1)]
            good = checksums(_covered(rows, head)) == (rows[:, HEADER].astype(np.uint32) << 8 | rows[:, HEADER + 1])
            bad += int((~good).sum())
            for i, row, ok in zip(which[lo : lo + 4096], rows, good.tolist(), strict=True):
                n = int(row[HEADER + CRC]) * UNIT
                parts[i] = row[head.body : head.body + n].tobytes() if ok else b""
    return bad, b"".join(parts[i] for i in sorted(parts))


def feature(s: Stream) -> str:
    """Duration as exact samples over rate, frames, table and seek points of a stream, as text."""
    seek = np.array(s.offsets, "<i8")
    marks = seek[:: max(1, -(-len(seek) // 8))].tolist() if len(seek) else []
    agrees = s.table_frames == len(s.offsets) + 1 and len(s.toc) == 100
    return (
        f"samples={s.samples}/{s.rate};frames={len(s.offsets)};bytes={sum(s.sizes)};table={int(agrees)};bad={s.bad};junk={s.junk};"
        f"seek={','.join(map(str, marks))};seek_crc32={zlib.crc32(seek.tobytes())}"
    )


def _encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, 1, 4 << 20):
        texts = [t.encode() if t else b"" for t in part.column(1).to_pylist()]
        media = pa.array([encode(pad(t), len(t)) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), media], ["doc_id", "media"])


def _decode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, 1, 4 << 20):
        rows = []
        for data in part.column(1).to_pylist():
            s = decode(data or b"")
            length = len(s.payload) if s.length is None else s.length
            rows.append((length, s.payload, len(data or b""), hashlib.sha256(data or b"").hexdigest(), s.samples, s.rate, s.offsets, s.bad, s.junk, feature(s)))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.string()]
        names = ["n_bytes", "payload", "media_bytes", "media_sha256", "samples", "sample_rate", "seek", "bad_frames", "junk_bytes", "feature"]
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and media (an MPEG audio stream) of each row of ``docs`` (doc_id, text, any others).

    A null text counts as empty. Rows that repeat get equal streams; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(per_batch(_encode), "doc_id long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """What the streams of ``media`` (doc_id, media) hold: payload, exact duration as samples over
    sample_rate, byte offset of every frame, damage found and a feature text.

    Frames whose checksum fails give no payload, nor do streams without the tag of ``to_media``. A null
    or empty stream has no frames. Rows that repeat give equal rows; an empty table gives none.
    """
    return media.select("doc_id", "media").mapInArrow(
        per_batch(_decode),
        "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, samples long, sample_rate int, "
        "seek array<long>, bad_frames int, junk_bytes long, feature string",
    )
