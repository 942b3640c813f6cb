"""MPEG transport streams in a binary column: writing them, and reading tables, counters, packets and timestamps back."""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import arrays as A

# Fixed values of the format.
PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
PAT_TABLE, PMT_TABLE = 0x00, 0x02
PRIVATE_STREAM, PRIVATE_DATA = 0xBD, 0x06
CLOCK = 90_000
CRC_POLYNOMIAL = 0x04C11DB7

PMT_PID, ES_PID, PROGRAM = 0x100, 0x101, 1
#: Bytes of payload in a PES packet; the clock ticks between two; every how many is marked as random-access point.
UNIT_BYTES, TICKS, ACCESS_EVERY = 16_384, 3_600, 4
BATCH_BYTES, ROWS = 4 << 20, 512


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (CRC_POLYNOMIAL if c >> 31 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


@dataclass
class Unit:
    """A PES packet: presentation and decoding time in ticks of 90 kHz (None without; decoding is at presentation if only that is
    given), whether decoding can start there, payload bytes, the clock reference of its first packet (27 MHz, None without)."""

    pts: int | None
    random_access: bool
    size: int
    dts: int | None = None
    clock: int | None = None


@dataclass
class Stream:
    """What demux() found: elementary streams of the first program, the payload of the first of them, its units, and faults."""

    packets: int = 0
    program: int | None = None
    streams: list[tuple[int, int]] = field(default_factory=list)  # (pid, stream type)
    payload: bytes = b""
    units: list[Unit] = field(default_factory=list)
    continuity_errors: int = 0
    sync_errors: int = 0
    crc_errors: int = 0


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 0xFF, (t >> 15 & 0x7F) << 1 | 1, t >> 7 & 0xFF, (t & 0x7F) << 1 | 1])


_TABLES = _table_packet(0, _section(PAT_TABLE, 1, bytes([PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))) + _table_packet(
    PMT_PID, _section(PMT_TABLE, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0, PRIVATE_DATA, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0]))
)


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES) -> bytes:
    """A stream with one program of one elementary stream that carries payload in PES packets of unit_bytes at most."""
    out, counter = [_TABLES], 0
    for no, at in enumerate(range(0, len(payload), unit_bytes)):
        data = payload[at : at + unit_bytes]
        pts = CLOCK + no * TICKS & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + data
        access = no % ACCESS_EVERY == 0
        field_ = bytes([0x10 | 0x40 * access]) + (pts << 15 | 0x7E00).to_bytes(6, "big")  # a clock reference
        first = min(len(pes), PACKET - 5 - len(field_))
        pad = PACKET - 5 - len(field_) - first
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter, len(field_) + pad]) + field_ + b"\xff" * pad + pes[:first])
        counter = counter + 1 & 15
        full = (len(pes) - first) // 184
        if full:
            body = np.empty((full, PACKET), np.uint8)
            body[:, 0], body[:, 1], body[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
            body[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            body[:, 4:] = np.frombuffer(pes, np.uint8, full * 184, first).reshape(full, 184)
            out.append(body.tobytes())
            counter = counter + full & 15
        rest = pes[first + full * 184 :]
        if rest:
            n = 183 - len(rest)
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter, n]) + (b"\0" + b"\xff" * (n - 1) if n else b"") + rest)
            counter = counter + 1 & 15
    return b"".join(out)


def _read_section(p: np.ndarray, at: int, found: Stream) -> bytes | None:
    raw = p[at:].tobytes()
    raw = raw[1 + raw[0] :]
    if len(raw) < 3 or (size := (raw[1] & 15) << 8 | raw[2]) + 3 > len(raw) or size < 9 or crc32_mpeg(raw[: size + 3]):
        found.crc_errors += 1
        return None
    return raw[: size - 1]


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def demux(media: bytes) -> Stream:
    """Reads a stream. Packets without the sync byte are skipped and counted, as are tables with a wrong checksum and gaps
    in the counters of a packet identifier; a packet repeated once whole is dropped. Bytes after the last whole packet are ignored.
    """
    found = Stream()
    p = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    ok = p[:, 0] == SYNC
    found.packets, found.sync_errors = len(p), int((~ok).sum())
    if found.sync_errors:
        p = p[ok]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    start, control, counter = p[:, 1] & 0x40 > 0, p[:, 3] >> 4 & 3, p[:, 3] & 15
    offset = np.where(control & 2, 5 + p[:, 4].astype(np.int32), 4)
    has = (control & 1 > 0) & (offset < PACKET)
    pmt = None
    for k in np.flatnonzero((pid == 0) & start & has):
        if (s := _read_section(p[k], offset[k], found)) and s[0] == PAT_TABLE:
            for e in range(8, len(s) - 3, 4):
                if number := s[e] << 8 | s[e + 1]:
                    found.program, pmt = number, (s[e + 2] & 31) << 8 | s[e + 3]
                    break
        if pmt is not None:
            break
    for k in np.flatnonzero((pid == pmt) & start & has) if pmt is not None else []:
        if (s := _read_section(p[k], offset[k], found)) and s[0] == PMT_TABLE:
            at = 12 + ((s[10] & 15) << 8 | s[11])
            while at + 5 <= len(s):
                found.streams.append(((s[at + 1] & 31) << 8 | s[at + 2], s[at]))
                at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])
            break
    for x in {0, pmt, *(i for i, _ in found.streams)} - {None}:
        at = np.flatnonzero((pid == x) & has)
        c = counter[at].astype(np.int32)
        if len(c) > 1:
            step = np.diff(c) & 15
            stay = np.flatnonzero(step == 0)  # a repeated packet has the same bytes
            found.continuity_errors += int((step > 1).sum()) + sum(bool((p[at[k]] != p[at[k + 1]]).any()) for k in stay)
    if not found.streams:
        return found
    own = np.flatnonzero((pid == found.streams[0][0]) & has)
    if len(own) > 1:
        again = np.zeros(len(own), bool)
        same = np.flatnonzero(counter[own][1:] == counter[own][:-1]) + 1
        again[same] = [bool((p[own[k]] == p[own[k - 1]]).all()) for k in same]
        own = own[~again]
    body, skip = p[own], offset[own]
    data = body[np.arange(PACKET) >= skip[:, None]].tobytes()
    ends = np.cumsum(PACKET - skip)
    begins = np.flatnonzero(start[own])
    parts = []
    for no, k in enumerate(begins):
        lo, hi = int(ends[k] - PACKET + skip[k]), int(ends[begins[no + 1] - 1]) if no + 1 < len(begins) else len(data)
        if data[lo : lo + 3] != b"\0\0\1" or hi - lo < 9:
            found.sync_errors += 1
            continue
        size, flags, head = int.from_bytes(data[lo + 4 : lo + 6], "big"), data[lo + 7], data[lo + 8]
        b = data[lo + 9 : lo + 14]
        pts = _read_stamp(b) if flags & 0x80 and head >= 5 and len(b) == 5 else None
        late = data[lo + 14 : lo + 19]
        dts = _read_stamp(late) if flags & 0xC0 == 0xC0 and head >= 10 and len(late) == 5 else pts
        adapted = control[own[k]] & 2 and body[k][4] >= 7 and body[k][5] & 0x10
        clock = int.from_bytes(body[k][6:12].tobytes(), "big") if adapted else None
        parts.append(data[lo + 9 + head : min(hi, lo + 6 + size) if size else hi])
        access = bool(control[own[k]] & 2 and body[k][4] and body[k][5] & 0x40)
        found.units.append(Unit(pts, access, len(parts[-1]), dts, (clock >> 15) * 300 + (clock & 0x1FF) if clock is not None else None))
    found.payload = b"".join(parts)
    return found


def _parts(batches):
    """Batches in parts of a few hundred rows, so that few rows are Python objects at a time."""
    for whole in batches:
        pa.default_memory_pool().release_unused()
        for at in range(0, whole.num_rows, ROWS):
            yield whole.slice(at, ROWS)


def transport_streams(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text (null: empty) as UTF-8, padded with zeros to a positive multiple of 64 bytes, as a stream.

    Equal texts give equal bytes. One row out for each row in, also for null ids and repeated rows; other columns are ignored.
    """

    def run(batches):
        for batch in _parts(batches):
            ids, sizes, media, held = [], [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (t or "").encode()
                ids.append(i)
                sizes.append(len(raw))
                media.append(mux(raw.ljust(max(64, -len(raw) % 64 + len(raw)), b"\0")))
                held += len(media[-1])
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    ids, sizes, media, held = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(A.tidy(run), "doc_id long, n_bytes long, media binary")


UNITS = "array<struct<pts: bigint, dts: bigint, clock: bigint, random_access: boolean, size: int>>"


def read_streams(media: DataFrame) -> DataFrame:
    """Adds to each row of (other columns, media) what demux() reads from it: payload, units, and `tables` and faults in one struct.

    A null or empty medium gives an empty payload and no units. Columns of the rows that are named like those added are replaced.
    """
    names = [c for c in media.columns if c.lower() not in ("media", "payload", "units", "found")]
    schema = ", ".join(f"`{c}` {dict(media.dtypes)[c]}" for c in [*names, "media"]) + f", payload binary, units {UNITS}, found struct<packets: int, program: int, pid: int, stream_type: int, continuity_errors: int, sync_errors: int, crc_errors: int>"

    def run(batches):
        for batch in _parts(batches):
            got = [demux(x or b"") for x in batch.column(len(names)).to_pylist()]
            units = pa.array([[{"pts": u.pts, "dts": u.dts, "clock": u.clock, "random_access": u.random_access, "size": u.size} for u in s.units] for s in got], pa.list_(pa.struct([("pts", pa.int64()), ("dts", pa.int64()), ("clock", pa.int64()), ("random_access", pa.bool_()), ("size", pa.int32())])))
            kinds = [(k, pa.int32()) for k in ("packets", "program", "pid", "stream_type", "continuity_errors", "sync_errors", "crc_errors")]
            facts = pa.array([{"packets": s.packets, "program": s.program, "pid": (s.streams or [(None, None)])[0][0], "stream_type": (s.streams or [(None, None)])[0][1], "continuity_errors": s.continuity_errors, "sync_errors": s.sync_errors, "crc_errors": s.crc_errors} for s in got], pa.struct(kinds))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.payload for s in got], pa.binary()), units, facts], [*batch.schema.names, "payload", "units", "found"])

    return media.select(*names, "media").mapInArrow(A.tidy(run), schema)


def media_features(docs: DataFrame) -> DataFrame:
    """The digest of each document's stream: sizes and hashes of the payload read back and of the stored form, and a feature
    string of packets, units, first and last timestamps and the places of random-access points.

    A row for each row of docs (doc_id, text): null texts count as empty and give one unit of zeros; null ids and repeated rows stay,
    equal texts give equal values. Other columns are ignored; an empty table gives an empty one.
    """
    rows = read_streams(transport_streams(docs))

    def run(batches):
        for batch in _parts(batches):
            c = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            out = []
            for payload, media, units, found in zip(c["payload"].to_pylist(), c["media"].to_pylist(), c["units"].to_pylist(), c["found"].to_pylist(), strict=True):
                access = ",".join(str(k) for k, u in enumerate(units) if u["random_access"])
                feature = f"packets={found['packets']};program={found['program']};pid={found['pid']};type={found['stream_type']};units={len(units)};pts={units[0]['pts'] if units else ''}-{units[-1]['pts'] if units else ''};access={access};gaps={found['continuity_errors']}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([c["doc_id"], c["n_bytes"], *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return rows.mapInArrow(A.tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
