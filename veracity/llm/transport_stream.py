"""Media columns as MPEG transport streams: write, parse, check and reassemble.

`mux` stores a payload as a programme of one private elementary stream: PAT and PMT at each random-access
point, one PES packet with a time stamp per access unit, split into packets of 188 bytes. `demux` parses the
program tables (checksums included, also of sections that span packets), checks continuity counters per PID (a
packet sent twice is taken once, a jump is no error where the packet announces it), reassembles the PES packets
(those without a length end where the next begins) and returns payload, time stamps and random-access points.

Cases: a null text is empty and is stored as one padded unit; equal texts give equal bytes; texts of any length
are handled whole, one row at a time in memory; null ids and repeated rows pass through; an empty table gives
an empty result; damage is counted (`errors`) and never raises, but bytes without sync bytes raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the transport stream format.
PACKET, SYNC, PAT_PID, PRIVATE_STREAM_1, PRIVATE_PES = 188, 0x47, 0x0000, 0xBD, 0x06
#: This writer's choices.
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
#: Payload rule: samples per frame, frames per access unit, clock ticks per frame (8 kHz samples, 90 kHz clock), units per random-access point.
FRAME, FRAMES_PER_UNIT, FRAME_TICKS, UNITS_PER_ACCESS = 576, 4, 6480, 8
UNIT = FRAME * FRAMES_PER_UNIT


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=1024)
def section_crc(data: bytes) -> int:
    """The checksum of program tables; over a section with its own checksum it is 0."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\x00" + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
_PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_PES, 0xE000 | ES_PID, 0xF000)))


def _pts(t: int) -> bytes:
    return bytes((0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE))


def pad(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the frame."""
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def _pes_packets(pes: bytes, access: bool, counter: int) -> np.ndarray:
    """The packets of one PES packet; stuffing goes into the last one's adaptation field."""
    lead = 2 if access else 0  # adaptation field of the first packet: its length and its flags
    n = max(1, -(-(len(pes) + lead) // (PACKET - 4)))
    stuffing = n * (PACKET - 4) - len(pes) - lead
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
    start = np.full(n, 4)
    start[0] += lead
    start[-1] += stuffing
    for i in {0, n - 1}:
        if (size := start[i] - 4) > 0:
            out[i, 3] |= 0x20
            out[i, 4] = size - 1
            if size > 1:
                out[i, 5] = 0x40 if access and i == 0 else 0
    out[np.arange(PACKET) >= start[:, None]] = np.frombuffer(pes, np.uint8)
    return out


def mux(payload: bytes) -> bytes:
    """A transport stream that holds the payload."""
    parts, counters = [], {PAT_PID: 0, ES_PID: 0}
    for i, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        if access := i % UNITS_PER_ACCESS == 0:
            for packet in (_PAT, _PMT):
                parts.append(packet[:3] + bytes((0x10 | counters[PAT_PID],)) + packet[4:])
            counters[PAT_PID] = (counters[PAT_PID] + 1) & 15
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM_1, len(data) + 8, 0x84, 0x80, 5) + _pts(i * FRAMES_PER_UNIT * FRAME_TICKS & (1 << 33) - 1) + data
        packets = _pes_packets(pes, access, counters[ES_PID])
        counters[ES_PID] = (counters[ES_PID] + len(packets)) & 15
        parts.append(packets.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    payload: bytes = b""
    es_pid: int | None = None
    stream_type: int | None = None
    pts: list[int] = field(default_factory=list)
    access: list[int] = field(default_factory=list)  # indexes of units that are random-access points
    errors: int = 0  # broken counters, checksums and lengths


def _sections(parts: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Whole sections from the payloads of a PID's packets, each with whether a section begins in it; cut-off ones are left out."""
    held: bytes | None = None
    for begins, data in parts:
        if begins:
            if not data or data[0] >= len(data):
                held = None
                continue
            if held is not None:
                held += data[1 : 1 + data[0]]
                if len(held) >= 3 and len(held) >= (size := 3 + (struct.unpack(">H", held[1:3])[0] & 0x0FFF)):
                    yield held[:size]
            held, data = b"", data[1 + data[0] :]
        if held is None:
            continue
        held += data
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + (struct.unpack(">H", held[1:3])[0] & 0x0FFF)):
            yield held[:size]
            held = held[size:]


def _usable(packets: np.ndarray, pid: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where each packet's payload begins, which packets have one to take, and the number of errors found in headers and counters."""
    adapted = (packets[:, 3] & 0x20) > 0
    start = np.where(adapted, 5 + packets[:, 4].astype(np.int32), 4)
    broken = ((packets[:, 1] & 0x80) > 0) | (start > PACKET)
    jump = adapted & (packets[:, 4] > 0) & ((packets[:, 5] & 0x80) > 0)
    take = ((packets[:, 3] & 0x10) > 0) & ~broken
    errors = int(broken.sum())
    for p in np.unique(pid[take & (pid != 0x1FFF)]):
        at = np.flatnonzero(take & (pid == p))
        step = np.diff(packets[at, 3].astype(np.int16) & 15) & 15
        twice = (step == 0) & (packets[at[1:], 4:] == packets[at[:-1], 4:]).all(1)
        twice[1:] &= ~twice[:-1]  # a packet may be sent twice, not more
        errors += int(((step != 1) & ~twice & ~jump[at[1:]]).sum())
        take[at[1:][twice]] = False
    return start, take, errors


def demux(media: bytes) -> Stream:
    """Parses a transport stream: the first elementary stream of its programmes."""
    out = Stream()
    if not media:
        return out
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid = ((packets[:, 1].astype(np.int32) & 0x1F) << 8) | packets[:, 2]
    start, take, out.errors = _usable(packets, pid)
    begins_unit = (packets[:, 1] & 0x40) > 0
    parts = lambda p: [(bool(begins_unit[i]), packets[i, start[i] :].tobytes()) for i in np.flatnonzero(take & (pid == p))]

    def tables(p: int, table_id: int, least: int) -> Iterator[bytes]:
        for s in _sections(parts(p)):
            if section_crc(s):
                out.errors += 1
            elif s[0] == table_id and len(s) >= least:
                yield s

    programs: dict[int, int] = {}
    for s in tables(PAT_PID, 0x00, 12):
        programs.update((n, p & 0x1FFF) for n, p in struct.iter_unpack(">HH", s[8 : len(s) - 4 - len(s) % 4]) if n)
    for pmt in dict.fromkeys(programs.values()):
        for s in tables(pmt, 0x02, 16):
            at = 12 + (struct.unpack(">H", s[10:12])[0] & 0x0FFF)
            while at + 5 <= len(s) - 4:
                kind, es, info = struct.unpack(">BHH", s[at : at + 5])
                if out.es_pid is None:
                    out.stream_type, out.es_pid = kind, es & 0x1FFF
                at += 5 + (info & 0x0FFF)
    if out.es_pid is None:
        return out
    mine = take & (pid == out.es_pid)
    own, start = packets[mine], start[mine]
    data = own[np.arange(PACKET) >= start[:, None]].tobytes()
    begins = np.flatnonzero(begins_unit[mine])
    ends = np.concatenate([[0], np.cumsum(PACKET - start)])
    random = ((own[:, 3] & 0x20) > 0) & (own[:, 4] > 0) & ((own[:, 5] & 0x40) > 0)
    units = []
    for k, first in enumerate(begins):
        pes = data[ends[first] : ends[begins[k + 1]] if k + 1 < len(begins) else len(data)]
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01" or len(pes) < 9 + pes[8] or (pes[7] & 0x80 and pes[8] < 5):
            out.errors += 1
            continue
        length = struct.unpack(">H", pes[4:6])[0]
        out.errors += length not in (0, len(pes) - 6)
        if random[first]:
            out.access.append(len(out.pts))
        if pes[7] & 0x80:
            a, b, c, d, e = pes[9:14]
            out.pts.append((a & 0x0E) << 29 | b << 22 | (c & 0xFE) << 14 | d << 7 | e >> 1)
        else:
            out.pts.append(-1)
        units.append(pes[9 + pes[8] :])
    out.payload = b"".join(units)
    return out


def features(s: Stream) -> str:
    """Stream type and PID, access units, duration in ms, broken counters, and the time stamps of the random-access points."""
    points = ",".join(str(s.pts[i]) for i in s.access)
    return f"type={s.stream_type};pid={s.es_pid};units={len(s.pts)};ms={len(s.payload) * FRAME_TICKS // FRAME // 90};errors={s.errors};access={points}"


def to_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the binary column `media` with each text's padded bytes as a transport stream."""

    @F.udf("binary", useArrow=True)
    def write(value: str | None) -> bytes:
        return mux(pad((value or "").encode()))

    return df.withColumn(media, write(text))


def from_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds the struct column `stream`: payload, time stamps, random-access points and errors."""

    @F.udf("payload binary, es_pid int, stream_type int, pts array<long>, access array<int>, errors int", useArrow=True)
    def read(value: bytes | None):
        s = demux(bytes(value or b""))
        return s.payload, s.es_pid, s.stream_type, s.pts, s.access, s.errors

    return df.withColumn("stream", read(media))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """Stores every text as a transport stream, reads the stored bytes back and digests both, one record batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = b"" if (v := text.as_buffer()) is None else bytes(v)
                media = mux(pad(raw))
                s = demux(media)
                rows.append((doc_id, len(raw), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(s)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW) if rows else pa.RecordBatch.from_pylist([], _ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, DIGEST)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
