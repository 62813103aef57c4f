"""Media columns: payloads stored as MPEG transport streams and read back.

A stream holds a program association table, a program map table and one elementary stream. The payload travels in
packetized elementary-stream units of ``unit_bytes`` with a presentation timestamp each; every ``gop``-th unit is a
random-access point and carries the program clock. Reading parses the tables, checks the continuity counters, leaves out repeated packets, reassembles
the units and keeps the timestamps with the random-access points.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trimmed

PACKET, SYNC, BODY = 188, 0x47, 184
PAT_PID, PMT_PID, MEDIA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data
CLOCK = 90_000
UNIT_BYTES, GOP, UNIT_TICKS = 4096, 8, 3600


class StreamError(ValueError):
    """The bytes aren't a transport stream that this module can read."""


@dataclass
class Stream:
    """What reading a transport stream gives."""

    payload: bytes = b""
    packets: int = 0
    program: int = 0
    pid: int = 0
    stream_type: int = 0
    discontinuities: int = 0
    duplicates: int = 0
    pcr: list[int] = field(default_factory=list)
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2, which program tables end with."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + struct.pack(">HHBBB", 0xB000 | (len(body) + 9), ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
_PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, STREAM_TYPE, 0xE000 | MEDIA_PID, 0xF000)))


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _pcr_bytes(ticks: int) -> bytes:
    """The program clock: 33 bits of 90 kHz, 6 reserved ones, 9 bits of 27 MHz that stay 0."""
    return ((ticks & 0x1FFFFFFFF) << 15 | 0x3F << 9).to_bytes(6, "big")


def write_stream(payload: bytes, unit_bytes: int = UNIT_BYTES, gop: int = GOP) -> bytes:
    """The payload as a transport stream. An empty payload gives the two tables alone."""
    out, cc = [_PAT, _PMT], 0
    for n, at in enumerate(range(0, len(payload), unit_bytes)):
        chunk = payload[at : at + unit_bytes]
        body = b"\0\0\1" + bytes([STREAM_ID]) + struct.pack(">H", len(chunk) + 8) + b"\x84\x80\x05" + _pts_bytes(n * UNIT_TICKS & 0x1FFFFFFFF) + chunk
        i, first = 0, True
        while i < len(body):
            flags = 0x50 if first and n % gop == 0 else 0  # random access, program clock
            clock = _pcr_bytes(n * UNIT_TICKS) if flags else b""
            room = BODY - (2 + len(clock)) * bool(flags)
            part = body[i : i + room]
            lead = struct.pack(">BH", SYNC, (0x4000 if first else 0) | MEDIA_PID)
            if flags or len(part) < BODY:
                length = BODY - 1 - len(part)
                field_ = bytes([length]) + ((bytes([flags]) + clock).ljust(length, b"\xff") if length else b"")
                out.append(lead + bytes([0x30 | cc]) + field_ + part)
            else:
                out.append(lead + bytes([0x10 | cc]) + part)
            i, first, cc = i + len(part), False, (cc + 1) & 15
    return b"".join(out)


def _read_section(body: bytes, table_id: int) -> bytes:
    start = 1 + body[0]
    if body[start] != table_id:
        raise StreamError(f"table {body[start]} where {table_id} is due")
    end = start + 3 + (struct.unpack_from(">H", body, start + 1)[0] & 0x0FFF)
    if section_crc(body[start:end]):
        raise StreamError(f"table {table_id} is damaged")
    return body[start + 8 : end - 4]


def read_stream(data: bytes) -> Stream:
    """Parses a transport stream. Raises StreamError if it is cut, has lost sync or lacks its tables."""
    if len(data) % PACKET:
        raise StreamError("the length isn't a multiple of 188")
    got, pmt_pid, cc, last, unit, parts = Stream(packets=len(data) // PACKET, pid=-1), -1, {}, {}, None, []

    def close() -> None:
        if unit is None:
            return
        body = b"".join(unit)
        if body[:3] != b"\0\0\1":
            raise StreamError("a unit has no start code")
        length, extra = struct.unpack_from(">H", body, 4)[0], body[8]
        if body[7] & 0x80:
            a, b, c, d, e = body[9:14]
            got.pts.append((a & 0x0E) << 29 | b << 22 | (c & 0xFE) << 14 | d << 7 | e >> 1)
        parts.append(body[9 + extra : 6 + length] if length else body[9 + extra :])

    for at in range(0, len(data), PACKET):
        if data[at] != SYNC:
            raise StreamError(f"no sync byte at {at}")
        word, control = struct.unpack_from(">HB", data, at + 1)
        pid, start, random_access = word & 0x1FFF, at + 4, False
        if control & 0x20:
            random_access = data[start] > 0 and bool(data[start + 1] & 0x40)
            if data[start] > 6 and data[start + 1] & 0x10:
                got.pcr.append(int.from_bytes(data[start + 2 : start + 8], "big") >> 15)
            start += 1 + data[start]
        if not control & 0x10:
            continue
        if pid in cc and control & 15 == cc[pid] & 15 and data[at + 4 : at + PACKET] == last[pid]:
            got.duplicates += 1  # a packet may be sent twice in a row
            continue
        if pid in cc and control & 15 != (cc[pid] + 1) & 15:
            got.discontinuities += 1
        cc[pid], last[pid] = control & 15, data[at + 4 : at + PACKET]
        body = data[start : at + PACKET]
        if pid == PAT_PID:
            got.program, pmt_pid = struct.unpack(">HH", _read_section(body, 0x00)[:4])
            pmt_pid &= 0x1FFF
        elif pid == pmt_pid:
            section = _read_section(body, 0x02)
            skip = 4 + (struct.unpack_from(">H", section, 2)[0] & 0x0FFF)
            got.stream_type, got.pid = section[skip], struct.unpack_from(">H", section, skip + 1)[0] & 0x1FFF
        elif pid == got.pid:
            if word & 0x4000:
                close()
                if random_access:
                    got.random_access.append(len(got.pts))
                unit = []
            if unit is not None:
                unit.append(body)
    close()
    if got.pid < 0:
        raise StreamError("no program tables")
    got.payload = b"".join(parts)
    return got


def media_column(df: DataFrame, key: str, data: str = "data", unit_bytes: int = UNIT_BYTES, gop: int = GOP) -> DataFrame:
    """Stores each row's bytes as a transport stream, reads the stream back and returns both.

    Columns: the key, media (the stream), payload (read back), pts and random_access (arrays), packets,
    discontinuities. Null bytes count as empty; repeated rows stay, each with its own stream; rows with equal bytes
    have equal streams. Other columns are dropped, so none can clash. An empty table gives an empty table.
    """
    small_batches(df.sparkSession)
    df = df.select(F.col(key).alias("k"), F.coalesce(F.col(data), F.lit("").cast("binary")).alias("d"))
    key_type = df.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            streams = [write_stream(x, unit_bytes, gop) for x in batch.column(1).to_pylist()]
            read = [read_stream(x) for x in streams]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(streams, pa.binary()), pa.array([r.payload for r in read], pa.binary()), pa.array([r.pts for r in read], pa.list_(pa.int64())),
                    pa.array([r.random_access for r in read], pa.list_(pa.int32())), pa.array([r.packets for r in read], pa.int64()), pa.array([r.discontinuities for r in read], pa.int64()),
                ],
                ["k", "media", "payload", "pts", "random_access", "packets", "discontinuities"],
            )

    out = df.mapInArrow(trimmed(run), f"k {key_type}, media binary, payload binary, pts array<bigint>, random_access array<int>, packets bigint, discontinuities bigint")
    return out.withColumnRenamed("k", key)


def media_digest(df: DataFrame) -> DataFrame:
    """The digest columns of documents(doc_id, text), taken from what media_column stored and read back.

    A null text counts as empty; its payload is one block of zeros.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    length = F.greatest(F.lit(64), F.ceil(F.octet_length("b") / 64) * 64).cast("int")
    padded = df.select("doc_id", text.alias("b")).select(F.struct("doc_id", F.octet_length("b").cast("long").alias("n_bytes")).alias("k"), F.rpad("b", length, F.lit(b"\0")).alias("data"))
    feature = F.concat_ws(
        ";",
        *(
            F.concat(F.lit(f"{name}="), value.cast("string"))
            for name, value in (("packets", F.col("packets")), ("units", F.size("pts")), ("last_pts", F.element_at("pts", -1)), ("random_access", F.size("random_access")), ("discontinuities", F.col("discontinuities")))
        ),
    )
    return media_column(padded, "k").select(
        "k.doc_id", "k.n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
