"""Streams of other writers, damage, and the media column's features against plain computations."""

from __future__ import annotations

import hashlib
import random
import struct

from veracity.llm import transport_stream as T


def packets(media):
    return [bytearray(media[i : i + 188]) for i in range(0, len(media), 188)]


def joined(parts):
    return b"".join(map(bytes, parts))


RAW = bytes(random.Random(1).randrange(256) for _ in range(30_000))
MEDIA = T.mux(T.pad(RAW))


def test_packets_sent_twice_count_once_and_announced_jumps_are_no_errors():
    p = packets(MEDIA)
    assert T.demux(joined([*p[:7], p[6], *p[7:]])).payload == T.pad(RAW) and T.demux(joined([*p[:7], p[6], *p[7:]])).errors == 0
    assert T.demux(joined([*p[:7], p[6], p[6], *p[7:]])).errors >= 1
    assert T.demux(joined([*p[:7], *p[8:]])).errors >= 1
    first = [i for i, x in enumerate(p) if x[1] & 0x40 and x[2] == 0 and x[1] & 0x1F == 1][8]  # a random-access point
    for x in p[first:]:
        if x[1] & 0x1F == 1 and x[2] == 0:
            x[3] = x[3] & 0xF0 | (x[3] + 5) & 15
    assert T.demux(joined(p)).errors == 1
    p[first][5] |= 0x80
    assert T.demux(joined(p)).errors == 0


def test_sections_over_several_packets_and_units_without_length():
    body = struct.pack(">HH", 0xE000 | T.ES_PID, 0xF000 | 300) + bytes([0x42]) * 300 + struct.pack(">BHH", 6, 0xE000 | T.ES_PID, 0xF000)
    section = b"\x00" + T._section(0x02, T.PROGRAM, body)
    pmt = []
    for i, at in enumerate(range(0, len(section), 184)):
        pmt.append(struct.pack(">BHB", T.SYNC, 0x4000 * (i == 0) | T.PMT_PID, 0x10 | i) + section[at : at + 184].ljust(184, b"\xff"))
    p = packets(MEDIA)
    es = [x for x in p if x[1] & 0x1F == 1 and x[2] == 0]
    for x in es:
        if x[1] & 0x40:
            at = 4 + (1 + x[4] if x[3] & 0x20 else 0)
            x[at + 4 : at + 6] = b"\0\0"
    s = T.demux(joined([p[0], *pmt, *es]))
    assert s.payload == T.pad(RAW) and s.errors == 0 and (s.es_pid, s.stream_type) == (T.ES_PID, 6)


def test_damage_is_counted_and_never_raises():
    rng = random.Random(2)
    for _ in range(300):
        m = bytearray(MEDIA[: 188 * 60])
        for _ in range(rng.randint(1, 30)):
            i = rng.randrange(len(m))
            if i % 188:
                m[i] = rng.randrange(256)
        s = T.demux(bytes(m))
        assert s.errors >= 0 and len(s.access) <= len(s.pts)
    assert T.demux(MEDIA[: 188 * 20]).errors >= 1  # cut off within a unit


def test_media_columns_and_features(spark):
    texts = [None, "", "é" * 5000, "x" * 575, "x" * 576, "y" * 20_000, "y" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = T.from_media(T.to_media(docs.withColumnsRenamed({"doc_id": "stream"}))).collect()
    for r in rows:
        raw = (r.text or "").encode()
        n = max(1, -(-len(raw) // 576)) * 576
        units = -(-n // 2304)
        assert r["stream"].payload == raw + b"\xff" * (n - len(raw)) and r["stream"].errors == 0
        assert r["stream"].pts == [i * 4 * 6480 for i in range(units)] and r["stream"].access == list(range(0, units, 8))
    for r in T.digest(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        n = max(1, -(-len(raw) // 576)) * 576
        units = -(-n // 2304)
        assert r.feature == f"type=6;pid=256;units={units};ms={n * 6480 // 576 // 90};errors=0;access={','.join(str(i * 25920) for i in range(0, units, 8))}"
        media = T.mux(T.pad(raw))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.media_bytes % 188 == 0
    assert T.digest(docs.limit(0)).count() == 0
