"""Documents as MPEG transport streams.

``mux`` stores a payload as one private elementary stream: a program association table, a program map table, and one
elementary packet for each access unit, with its presentation time; every eighth unit is a random-access point and
carries the program clock.  ``demux`` reads any such stream back from its bytes alone: it parses the program tables
(their checksums too), checks the continuity counters, drops repeated packets, reassembles the elementary packets
and lists timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Fixed values of the format: packet size, sync byte, table ids, clock, and the ids used by ``mux``.
PACKET, SYNC, CLOCK = 188, 0x47, 90_000
PAT_PID, PMT_PID, DATA_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0, 0x1000, 0x100, 1, 0x06, 0xBD
UNIT, UNIT_TICKS, RANDOM_EVERY = 4096, 3600, 8
PAD = 64


def _checksums() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_TABLE = _checksums()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for byte in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _TABLE[c >> 24 ^ byte]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)
_HEADS = [bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x10 | c]) for c in range(16)]


def _stamp(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 255, 0x01 | ticks >> 14 & 0xFE, ticks >> 7 & 255, 0x01 | ticks << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    out = [_TABLES]
    counter = 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        ticks = unit * UNIT_TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(ticks) + data
        place, flags = 0, b""
        if unit % RANDOM_EVERY == 0:
            flags = b"\x50" + (ticks << 15 | 0x7E00).to_bytes(6, "big")
        while place < len(pes):
            room = PACKET - 4 - (1 + len(flags) if flags else 0)
            part = pes[place : place + room]
            head = _HEADS[counter]
            if not place or flags or len(part) < room:
                head = bytes([SYNC, (0x40 if not place else 0) | DATA_PID >> 8, DATA_PID & 255, 0x10 | counter])
                space = PACKET - 4 - len(part)
                if space:
                    field_ = (flags or (b"\x00" if space > 1 else b"")).ljust(space - 1, b"\xff")
                    head = head[:3] + bytes([0x30 | counter, space - 1]) + field_
            out += head, part
            place, flags, counter = place + len(part), b"", counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    programs: dict[int, int] = field(default_factory=dict)  # program number -> id of its map
    streams: dict[int, tuple[int, int]] = field(default_factory=dict)  # id -> (program, stream type)
    data: dict[int, list[bytes]] = field(default_factory=dict)
    times: dict[int, list[int]] = field(default_factory=dict)
    random: dict[int, list[int]] = field(default_factory=dict)  # numbers of the elementary packets that are random-access points
    packets: int = 0
    gaps: int = 0
    repeats: int = 0
    faults: int = 0


def _read_section(s: Stream, pid: int, body: bytes) -> None:
    body = body[1 + body[0] :] if body else b""
    if len(body) < 3:
        s.faults += 1
        return
    end = 3 + ((body[1] & 15) << 8 | body[2])
    if end > len(body) or end < 12 or section_crc(body[:end]):
        s.faults += 1
    elif pid == PAT_PID and body[0] == 0:
        for k in range(8, end - 4, 4):
            s.programs[body[k] << 8 | body[k + 1]] = (body[k + 2] & 31) << 8 | body[k + 3]
    elif body[0] == 2:
        k = 12 + ((body[10] & 15) << 8 | body[11])
        while k + 5 <= end - 4:
            s.streams[(body[k + 1] & 31) << 8 | body[k + 2]] = (body[3] << 8 | body[4], body[k])
            k += 5 + ((body[k + 3] & 15) << 8 | body[k + 4])


def _read_packet(s: Stream, pid: int, pes: bytes) -> None:
    if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
        s.faults += 1
        return
    length = pes[4] << 8 | pes[5]
    if length and len(pes) < 6 + length:
        s.faults += 1
    if pes[7] & 0x80 and len(pes) >= 14:
        s.times[pid].append((pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1)
    s.data[pid].append(pes[9 + pes[8] : 6 + length if length else len(pes)])


def demux(media: bytes) -> Stream:
    s = Stream()
    counters: dict[int, int] = {}
    last: dict[int, bytes] = {}
    parts: dict[int, list[bytes]] = {}
    maps: set[int] = set()
    for at in range(0, len(media) - PACKET + 1, PACKET):
        s.packets += 1
        if media[at] != SYNC or media[at + 1] & 0x80:
            s.faults += 1
            continue
        pid, control = (media[at + 1] & 31) << 8 | media[at + 2], media[at + 3]
        has_data, begin = control & 0x10, at + 4
        flags = 0
        if control & 0x20:
            begin += 1 + media[at + 4]
            flags = media[at + 5] if media[at + 4] else 0
        if has_data:
            counter = control & 15
            before = counters.get(pid)
            if before is not None and counter != before + 1 & 15 and not flags & 0x80:
                if counter == before and media[at : at + PACKET] == last.get(pid):
                    s.repeats += 1
                    continue
                s.gaps += 1
            counters[pid] = counter
            last[pid] = media[at : at + PACKET]
        if pid == PAT_PID or pid in maps:
            if media[at + 1] & 0x40 and has_data:
                _read_section(s, pid, media[begin : at + PACKET])
                maps = set(s.programs.values())
        elif pid in s.streams and has_data:
            if media[at + 1] & 0x40:
                if parts.get(pid):
                    _read_packet(s, pid, b"".join(parts[pid]))
                parts[pid] = []
                for kept in (s.data, s.times, s.random):
                    kept.setdefault(pid, [])
                if flags & 0x40:
                    s.random[pid].append(len(s.data[pid]))
            if pid in parts:
                parts[pid].append(media[begin : at + PACKET])
    for pid, rest in parts.items():
        if rest:
            _read_packet(s, pid, b"".join(rest))
    return s


def padded(text: bytes) -> bytes:
    return text + bytes(PAD - len(text) % PAD if len(text) % PAD or not text else 0)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a stream; a null text is empty (64 zero bytes of payload)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        media = [mux(padded(t)) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")), step, f"doc_id {kind}, n_bytes long, media binary")


READ = (
    "doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, programs int, streams int, packets long, "
    "elementary_packets long, continuity_gaps long, repeated_packets long, faults long, times array<long>, random_access array<int>"
)


def read(stored: DataFrame) -> DataFrame:
    """Read (doc_id, n_bytes, media) back: digests of the payload and what the stream says about itself."""
    schema = READ.format(kind=stored.schema["doc_id"].dataType.simpleString())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for media in batch.column("media").to_pylist():
            s = demux(media or b"")
            payload = b"".join(x for pid in sorted(s.data) for x in s.data[pid])
            rows.append((
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), len(s.programs), len(s.streams), s.packets,
                sum(map(len, s.data.values())), s.gaps, s.repeats, s.faults, [t for pid in sorted(s.times) for t in s.times[pid]], [r for pid in sorted(s.random) for r in s.random[pid]],
            ))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [x.strip().split()[0] for x in READ.split(",")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names)

    return map_arrow(stored.select("doc_id", "n_bytes", "media"), step, schema)
