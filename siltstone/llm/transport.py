"""Media columns: MPEG transport streams (ISO/IEC 13818-1), 188-byte packets.

``demux`` parses the program association and map tables, checks the continuity counter of every PID,
reassembles elementary packets and keeps their time stamps and random-access points. ``mux`` stores a
payload as one private-data stream, so that payloads can be kept losslessly in a media column. Both work
on whole arrays of packets with numpy.

Tables are read over all packets of their PIDs, from sections put together over packets; only sections
marked current count, and a later version takes over.

Nulls and damage: a null value has no packets. Bytes before the first sync byte and packets with a wrong
sync byte or the transport error flag are counted and skipped; a missing table gives no streams. Nothing
raises on bad input. Equal values give equal results, so repeated rows and ties do too. A very long text or
value is stored and parsed whole, by itself. An empty table gives an empty result. Only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import slices

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, STREAM_TYPE, STREAM_ID = 0x100, 0x101, 0x06, 0xBD
UNIT_BYTES, UNIT_TICKS, UNITS_PER_POINT = 4096, 3600, 8
COLUMNS = np.arange(PACKET)


def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2, polynomial 0x04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
            crc &= 0xFFFFFFFF
    return crc


def section_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    section += crc_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet.ljust(PACKET, b"\xff")


TABLES = section_packet(0, 0x00, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big")) + section_packet(
    PMT_PID, 0x02, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def stamp(prefix: int, ticks: int) -> bytes:
    return bytes([prefix << 4 | ticks >> 29 & 14 | 1, ticks >> 22 & 255, ticks >> 14 & 254 | 1, ticks >> 7 & 255, ticks << 1 & 254 | 1])


def read_stamp(b: bytes) -> int:
    return (b[0] & 14) << 29 | b[1] << 22 | (b[2] & 254) << 14 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """Store a payload: tables, then one elementary packet for every UNIT_BYTES, time-stamped, with a
    random-access point and clock reference at the first of every UNITS_PER_POINT."""
    parts, lengths, first, points = [], [], [], []
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit = payload[at : at + UNIT_BYTES]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(2, k * UNIT_TICKS) + unit
        point = k % UNITS_PER_POINT == 0
        room = 176 if point else 184
        sizes = [min(room, len(pes))]
        rest = len(pes) - sizes[0]
        sizes += [184] * (rest // 184) + ([rest % 184] if rest % 184 else [])
        parts.append(pes)
        first += [True] + [False] * (len(sizes) - 1)
        points += [point] + [False] * (len(sizes) - 1)
        lengths += sizes
    n = len(lengths)
    if not n:
        return TABLES
    size, start, point = np.array(lengths), np.array(first), np.array(points)
    out = np.full((n, PACKET), 255, np.uint8)
    out[:, 0] = SYNC
    out[:, 1] = DATA_PID >> 8 | start * 0x40
    out[:, 2] = DATA_PID & 255
    out[:, 3] = 0x10 | (size < 184) * 0x20 | np.arange(n) % 16
    short = size < 184
    out[short, 4] = 183 - size[short]
    flagged = size < 183
    out[flagged, 5] = 0
    if point.any():
        base = np.cumsum(start)[point] - 1
        ticks = base.astype(np.int64) * UNIT_TICKS
        out[point, 5] = 0x50
        for i, shift in enumerate((25, 17, 9, 1)):
            out[point, 6 + i] = ticks >> shift & 255
        out[point, 10] = (ticks & 1) << 7 | 0x7E
        out[point, 11] = 0
    out[COLUMNS >= PACKET - size[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    return TABLES + out.tobytes()


def sections(packets: np.ndarray) -> Iterator[bytes]:
    """Sections of one PID with a right checksum, put together over packets by their length.

    A repeated packet is skipped; where one is lost, what is open is dropped up to the next start."""
    held, last = None, None
    for p in packets:
        raw = p.tobytes()
        if not raw[3] & 0x10:
            continue
        at = 4 + (raw[4] + 1 if raw[3] & 0x20 else 0)
        jump = raw[3] & 0x20 and at > 5 and raw[5] & 0x80
        if last is not None and not jump:
            if (raw[3] - last[3]) & 15 == 0 and raw[4:] == last[4:]:
                continue
            if (raw[3] - last[3]) & 15 != 1:
                held = None
        elif jump:
            held = None
        last = raw
        body = raw[at:]
        if raw[1] & 0x40:
            if not body or body[0] >= len(body):
                held = None
                continue
            found, _ = closed(held + body[1 : 1 + body[0]]) if held is not None else ([], None)
            yield from found
            held = body[1 + body[0] :]
        elif held is not None:
            held += body
        if held is not None:
            found, held = closed(held)
            yield from found


def closed(data: bytes) -> tuple[list[bytes], bytes | None]:
    """(whole sections with a right checksum, the beginning of the next one; None where stuffing follows)."""
    out, at = [], 0
    while at < len(data) and data[at] != 0xFF:
        if at + 3 > len(data) or (end := at + 3 + ((data[at + 1] & 15) << 8 | data[at + 2])) > len(data):
            return out, data[at:]
        if end - at >= 12 and crc_mpeg(data[at:end]) == 0:
            out.append(data[at:end])
        at = end
    return out, None if at < len(data) else b""


def applied(packets: np.ndarray, table_id: int) -> Iterator[bytes]:
    """Sections of a table as they come into force: current ones, each number of a version once."""
    last: dict[int, bytes] = {}
    for s in sections(packets):
        if s[0] == table_id and s[5] & 1 and last.get(s[6]) != s:
            last[s[6]] = s
            yield s


def programs(packets: np.ndarray, pids: np.ndarray) -> dict[int, dict]:
    """Program number to its map PID and version, clock PID and stream types by PID. A later version of a
    table takes over; streams of earlier ones stay listed, since their packets came before it."""
    out: dict[int, dict] = {}
    maps: dict[int, list[int]] = {}
    for s in applied(packets[pids == 0], 0):
        for i in range(8, len(s) - 4, 4):
            if number := s[i] << 8 | s[i + 1]:
                pid = (s[i + 2] & 31) << 8 | s[i + 3]
                out.setdefault(number, {"pcr": None, "version": None, "streams": {}})["pmt"] = pid
                if pid not in maps.setdefault(number, []):
                    maps[number].append(pid)
    for number, program in out.items():
        for pid in maps[number]:
            for s in applied(packets[pids == pid], 2):
                if s[3] << 8 | s[4] != number:
                    continue
                program["version"], program["pcr"] = s[5] >> 1 & 31, (s[8] & 31) << 8 | s[9]
                i = 12 + ((s[10] & 15) << 8 | s[11])
                while i + 5 <= len(s) - 4:
                    program["streams"][(s[i + 1] & 31) << 8 | s[i + 2]] = s[i]
                    i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    return out


def demux(data: bytes | None) -> dict:
    """programs, packets, skipped, continuity errors, and for each stream its elementary packets as
    (pts, dts, random access, bytes)."""
    out: dict = {"packets": 0, "skipped": 0, "errors": 0, "programs": {}, "units": {}}
    data = data or b""
    at = 0
    while at < len(data) and (data[at] != SYNC or at + PACKET < len(data) and data[at + PACKET] != SYNC):
        at += 1
    n = (len(data) - at) // PACKET
    if n <= 0:
        return out
    packets = np.frombuffer(data, np.uint8, n * PACKET, at).reshape(n, PACKET)
    good = (packets[:, 0] == SYNC) & (packets[:, 1] & 0x80 == 0)
    out["packets"], out["skipped"] = n, int(n - good.sum())
    if out["skipped"]:
        packets = packets[good]
    pids = (packets[:, 1].astype(np.int64) & 31) << 8 | packets[:, 2]
    out["programs"] = programs(packets, pids)
    streams = {pid for p in out["programs"].values() for pid in p["streams"]}
    for pid in sorted(streams):
        own = packets[pids == pid]
        control = own[:, 3]
        adapted = control & 0x20 > 0
        af = np.where(adapted, own[:, 4].astype(np.int64), -1)
        flags = np.where(af > 0, own[:, 5], 0)
        carries = control & 0x10 > 0
        start = np.minimum(np.where(adapted, 5 + af, 4), PACKET)
        count = control & 15
        step = (count[1:].astype(np.int64) - count[:-1]) % 16
        repeat = (step == 0) & carries[1:] & carries[:-1] & (own[1:, 4:] == own[:-1, 4:]).all(axis=1) if len(own) > 1 else np.zeros(0, bool)
        wrong = (step != carries[1:]) & ~repeat & (flags[1:] & 0x80 == 0)
        out["errors"] += int(wrong.sum())
        use = carries & np.concatenate([[True], ~repeat])[: len(own)]
        own, start, flags = own[use], start[use], flags[use]
        begins = np.flatnonzero(own[:, 1] & 0x40)
        body = own[COLUMNS >= start[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(PACKET - start)])
        units = []
        for k, b in enumerate(begins):
            stop = begins[k + 1] if k + 1 < len(begins) else len(own)
            pes = body[ends[b] : ends[stop]]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                out["errors"] += 1
                continue
            said = pes[4] << 8 | pes[5]
            pts = read_stamp(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None
            dts = read_stamp(pes[14:19]) if pes[7] & 0xC0 == 0xC0 and len(pes) >= 19 else pts
            units.append((pts, dts, bool(flags[b] & 0x40), pes[9 + pes[8] : 6 + said if said else len(pes)]))
        out["units"][pid] = units
    return out


def feature(found: dict) -> str:
    """What the stream holds, without its bytes."""
    out = [f"packets={found['packets']}", f"skipped={found['skipped']}", f"continuity_errors={found['errors']}"]
    for number, p in sorted(found["programs"].items()):
        out.append(f"program={number}@{p['pmt']}:pcr={p['pcr']}:" + ",".join(f"{pid}/{kind}" for pid, kind in sorted(p["streams"].items())))
    for pid, units in sorted(found["units"].items()):
        stamps = [u[0] for u in units if u[0] is not None]
        points = [u[0] for u in units if u[2]]
        out.append(f"pid={pid}:units={len(units)}:pts={min(stamps, default='')}-{max(stamps, default='')}:points={len(points)}" + (f"@{points[0]}-{points[-1]}" if points else ""))
    return ";".join(out)


RESULT_SCHEMA = "packets long, skipped long, continuity_errors long, feature string, units array<struct<pid:int,stream_type:int,pts:long,dts:long,random_access:boolean,data:binary>>"
UNIT_TYPES = {"pid": pa.int32(), "stream_type": pa.int32(), "pts": pa.int64(), "dts": pa.int64(), "random_access": pa.bool_(), "data": pa.binary()}


def demux_column(df: DataFrame, bytes_col: str, id_col: str) -> DataFrame:
    """(id, packets, skipped, continuity_errors, feature, units) of a column that holds transport streams: a
    row for each row, equal ones for equal values; a null, an empty value or one without packets has no
    unit. Values are taken in runs of bounded bytes, or one by one where they are longer."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{bytes_col}`").cast("binary").alias("_data"))

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                own, ends = batch.slice(a, b), [0]
                units: dict[str, list] = {k: [] for k in UNIT_TYPES}
                head: list[list] = [[], [], [], []]
                for value in own.column(1):
                    found = demux(value.as_py())
                    kinds = {pid: kind for p in found["programs"].values() for pid, kind in p["streams"].items()}
                    for pid, held in sorted(found["units"].items()):
                        for u in held:
                            for to, v in zip(units.values(), (pid, kinds[pid], *u), strict=True):
                                to.append(v)
                    ends.append(len(units["pid"]))
                    for to, v in zip(head, (found["packets"], found["skipped"], found["errors"], feature(found)), strict=True):
                        to.append(v)
                flat = pa.StructArray.from_arrays([pa.array(v, UNIT_TYPES[k]) for k, v in units.items()], names=list(UNIT_TYPES))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                columns = [own.column(0), *(pa.array(v, pa.int64()) for v in head[:3]), pa.array(head[3], pa.string()), listed]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "packets", "skipped", "continuity_errors", "feature", "units"])

    return rows.mapInArrow(run, f"id long, {RESULT_SCHEMA}")


def payload(raw: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a transport stream, read it back, and describe both; a null text is empty."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(1).cast(pa.binary()):
                raw = value.as_py() or b""
                media = mux(payload(raw))
                found = demux(media)
                back = b"".join(u[3] for u in found["units"][DATA_PID])
                row = len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(found)
                for to, v in zip(out, row, strict=True):
                    to.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=["doc_id", *names])

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {DIGESTS}")
