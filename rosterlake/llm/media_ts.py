"""MPEG transport streams as a media column: writing, demultiplexing, timestamps, random access.

A stream starts with its program tables (PAT on packet id 0, PMT on 0x1000), then carries one
private elementary stream on 0x100: units of UNIT bytes, each a PES packet with a presentation
time. Every GOP-th unit starts with the random-access flag. parse() reads the tables (and checks
their CRC), follows each packet id's continuity counter, reassembles the PES packets and returns
payload, timestamps and random-access points.

Edge cases: null text is stored as the empty text (64 zero bytes); a text whose length is a
positive multiple of 64 gets no padding; equal texts give equal streams and features; a lost
or torn packet raises ValueError in parse(strict=True) and is counted otherwise; a packet sent twice in a
row is legal and read once; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm._common import load, parts, ship, stored

#: Fixed values of the container.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID, CLOCK, POLY = 188, 0x47, 0x0000, 0x1000, 0x0100, 0x06, 0xBD, 90_000, 0x04C11DB7
UNIT, GOP, TICK = 4096, 8, 3003


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables: most significant bit first, not inverted."""
    c = 0xFFFFFFFF
    for byte in data:
        c ^= byte << 24
        for _ in range(8):
            c = (c << 1 ^ (POLY if c & 0x80000000 else 0)) & 0xFFFFFFFF
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + (b"\0" + section).ljust(PACKET - 4, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _table_packet(PMT_PID, _section(2, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000)))


def _pts_bytes(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 29 & 0x0E), (pts >> 14 & 0xFFFE) | 1, (pts << 1 & 0xFFFE) | 1)


def _packets(pes: bytes, counter: int, random_access: bool) -> tuple[bytes, int]:
    """One PES packet in transport packets; the last one (and a flagged first one) has an adaptation field."""
    room = PACKET - 4
    first = b""
    if random_access:
        lead = min(len(pes), room - 2)
        first = struct.pack(">BHBBB", SYNC, 0x4000 | ES_PID, 0x30 | counter, room - 1 - lead, 0x40) + b"\xff" * (room - 2 - lead) + pes[:lead]
        pes, counter = pes[lead:], (counter + 1) & 15
    full, rest = divmod(len(pes), room)
    body = np.empty((full, PACKET), np.uint8)
    body[:, :4] = (SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x10)
    body[:, 3] |= ((np.arange(full) + counter) & 15).astype(np.uint8)
    body[:, 4:] = np.frombuffer(pes, np.uint8, full * room).reshape(full, room)
    if full and not random_access:
        body[0, 1] |= 0x40
    counter = (counter + full) & 15
    last = b""
    if rest:
        start = 0x4000 if not full and not random_access else 0
        stuff = room - rest - 1
        last = struct.pack(">BHBB", SYNC, start | ES_PID, 0x30 | counter, stuff) + (b"\0" + b"\xff" * (stuff - 1) if stuff else b"") + pes[full * room :]
        counter = (counter + 1) & 15
    return first + body.tobytes() + last, counter


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter = [_TABLES], 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        head = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(unit) + 8, 0x84, 0x80, 5) + _pts_bytes(n * TICK & (1 << 33) - 1)
        packets, counter = _packets(head + unit, counter, n % GOP == 0)
        out.append(packets)
    return b"".join(out)


@dataclass
class Stream:
    """What parse() found: the payload, and per unit its timestamp, offset, size and random-access flag."""

    payload: bytes = b""
    program: int = 0
    stream_type: int = 0
    packets: int = 0
    gaps: int = 0
    doubles: int = 0
    units: list[tuple[int, int, int, bool]] = field(default_factory=list)


def _read_section(packet: bytes) -> bytes:
    at = 5 + packet[4]
    size = (packet[at + 1] & 15) << 8 | packet[at + 2]
    section = packet[at : at + 3 + size]
    if section_crc(section):
        raise ValueError("bad table checksum")
    return section


_section_seen: dict[bytes, bytes] = {}


def _section_of(packet: bytes) -> bytes:
    """Tables repeat from stream to stream; each distinct one is checked once."""
    if packet not in _section_seen:
        if len(_section_seen) > 1000:
            _section_seen.clear()
        _section_seen[packet] = _read_section(packet)
    return _section_seen[packet]


def parse(stream: bytes, strict: bool = True) -> Stream:
    """Demultiplex the first program's first elementary stream."""
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid = (p[:, 1].astype(np.uint16) & 0x1F) << 8 | p[:, 2]
    found = Stream(packets=len(p))
    tables = np.flatnonzero(pid == PAT_PID)
    if not len(tables):
        raise ValueError("no program table")
    pat = _section_of(p[tables[0]].tobytes())
    found.program, pmt_pid = struct.unpack_from(">HH", pat, 8)
    maps = np.flatnonzero(pid == (pmt_pid & 0x1FFF))
    if not len(maps):
        raise ValueError("no program map")
    pmt = _section_of(p[maps[0]].tobytes())
    at = 12 + (struct.unpack_from(">H", pmt, 10)[0] & 0xFFF)
    found.stream_type, es_pid = struct.unpack_from(">BH", pmt, at)
    own = p[pid == (es_pid & 0x1FFF)]
    # a packet may be sent twice in a row; the second one says nothing new
    again = np.concatenate(([False], (own[1:] == own[:-1]).all(1) & (own[1:, 3] & 0x10 > 0))) if len(own) else np.zeros(0, bool)
    own, found.doubles = own[~again], int(again.sum())
    has_field, has_payload = own[:, 3] & 0x20 > 0, own[:, 3] & 0x10 > 0
    step = np.diff(own[has_payload, 3].astype(np.int16) & 15) & 15
    found.gaps = int((step != 1).sum())
    if found.gaps and strict:
        raise ValueError(f"{found.gaps} breaks of the continuity counter")
    begins = np.flatnonzero(own[:, 1] & 0x40)
    offset = np.where(has_field, 5 + own[:, 4].astype(np.int64), 4)
    random_access = has_field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    parts, size = [], 0
    for a, b in zip(begins, [*begins[1:], len(own)], strict=True):
        odd = offset[a:b] != 4
        if odd[1:-1].any():
            pes = b"".join(own[i, offset[i] :].tobytes() for i in range(a, b))
        else:
            pes = own[a, offset[a] :].tobytes() + (own[a + 1 : b - 1, 4:].tobytes() + own[b - 1, offset[b - 1] :].tobytes() if b - a > 1 else b"")
        if pes[:3] != b"\0\0\1":
            raise ValueError("no packet start")
        length = struct.unpack_from(">H", pes, 4)[0]
        t = pes[9:14]
        pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
        unit = pes[9 + pes[8] : 6 + length]
        if len(pes) < 6 + length and strict:
            raise ValueError("torn packet")
        found.units.append((pts, size, len(unit), bool(random_access[a])))
        parts.append(unit)
        size += len(unit)
    found.payload = b"".join(parts)
    return found


def padded(text: bytes) -> bytes:
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def feature(s: Stream) -> str:
    """Units, packets, duration in milliseconds, random-access points and a digest of the time line."""
    line = np.array([(t, o, n) for t, o, n, _ in s.units], "<i8").tobytes()
    last = (s.units[-1][0] + TICK) * 1000 // CLOCK if s.units else 0
    return f"units={len(s.units)};packets={s.packets};ms={last};random_access={sum(r for *_, r in s.units)};gaps={s.gaps};timeline={zlib.crc32(line):08x}"


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and the media column, written to the shared folder and read back."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(parts(x, 1) for x in batches):
            raw = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array([mux(padded(t)) for t in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return stored(docs.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def demux(media: DataFrame, column: str = "media") -> DataFrame:
    """All columns but the media, plus units array<struct<pts, at, size, random_access>> and the digests."""
    ship(media.sparkSession)
    from pyspark.sql import types as T

    rest = [c for c in media.columns if c != column]
    added = T.StructType().add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string")
    unit = T.ArrayType(T.StructType().add("pts", "long").add("at", "long").add("size", "long").add("random_access", "boolean"))
    added.add("units", unit)
    kinds = pa.list_(pa.struct([("pts", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("random_access", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(parts(x, x.num_columns - 1) for x in batches):
            raw = b.column(b.num_columns - 1).to_pylist()
            got = [parse(m) for m in raw]
            new = [
                pa.array([len(s.payload) for s in got], pa.int64()), pa.array([hashlib.sha256(s.payload).hexdigest() for s in got]), pa.array([zlib.crc32(s.payload[-64:]) for s in got], pa.int64()),
                pa.array([len(m) for m in raw], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in raw]), pa.array([feature(s) for s in got]),
                pa.array([[{"pts": t, "at": o, "size": n, "random_access": r} for t, o, n, r in s.units] for s in got], kinds),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*rest, *added.names])

    frame = media.select(*rest, column)
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], *added.fields]))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux(store(load(spark, sf_dir, "documents", spread=True))).drop("units")
