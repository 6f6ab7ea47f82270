"""Media columns: MPEG transport streams (ISO/IEC 13818-1) in binary columns.

``mux`` stores payloads as one program with one private-data stream: program tables, packetised
elementary packets of at most ``UNIT`` payload bytes with a timestamp each, random-access points
every ``RAP_EVERY`` of them, and continuity counters. ``demux`` reads a stored stream: it assembles
the sections of the program tables and checks the checksum of every copy, drops duplicate packets,
checks continuity, finds the stream's packet identifier through the program tables, reassembles the
elementary packets and returns payload, timestamps and random-access points. Both work on whole
packet arrays, so the cost per document is a few array operations.

Of the association table the first program counts (entries of program 0 name the network), of the
map its first stream. What can't be read raises ValueError: lost synchronisation, flagged or scrambled
packets, a damaged or changed table, an elementary packet that is shorter than it says. A packet that
repeats the one before it once is legal and read once; other breaks of the counters are counted, but
where a packet announces a discontinuity.

A null text is stored as empty, a null media value gives nulls. Repeated rows are read each; nothing
is ordered, so there are no ties. An empty table gives no rows. A text of any length is one stream,
held whole by the task that has it. store() and digests() return their own columns only; read() keeps
the others, under the name stored_<name> if it is one of those it adds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import bounded_batches
from .words import buffers

BLOCK = 192
#: Payload bytes of one elementary packet, at most; its 16-bit length has room for more.
UNIT = 64 * BLOCK
RAP_EVERY = 8
TICKS = 3000
PAT_PID, PMT_PID, DATA_PID = 0, 0x100, 0x101
PRIVATE_DATA = 0x06


def crc_mpeg(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + crc_mpeg(head).to_bytes(4, "big")


def program_sections() -> tuple[bytes, bytes]:
    """The association table (program 1) and the map table (one private-data stream)."""
    pat = _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_DATA, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))
    return pat, pmt


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    packet = np.full(188, 0xFF, np.uint8)
    packet[:5] = [0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]
    packet[5 : 5 + len(section)] = np.frombuffer(section, np.uint8)
    return packet


def pad(text: bytes) -> bytes:
    """Spaces up to a positive multiple of the block."""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b" ")


def _timestamp(pts: int, mark: int) -> bytes:
    return bytes([mark << 4 | pts >> 29 & 14 | 1, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def mux(payload: bytes, tables: np.ndarray | None = None) -> bytes:
    """A transport stream of the payload."""
    if tables is None:
        tables = np.stack([_table_packet(p, s) for p, s in zip((PAT_PID, PMT_PID), program_sections(), strict=True)])
    out, counter, shown = [], 0, 0
    for i, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        part = payload[at : at + UNIT]
        pts = i * TICKS & (1 << 33) - 1
        length = 8 + len(part)
        body = np.frombuffer(b"\0\0\1\xbd" + length.to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(pts, 2) + part, np.uint8)
        entry = i % RAP_EVERY == 0
        if entry:
            shown_tables = tables.copy()
            shown_tables[:, 3] |= shown & 15
            shown += 1
            out.append(shown_tables)
        n = len(body)
        count = 1 + max(0, -(-(n - 176) // 184))
        packets = np.empty((count, 188), np.uint8)
        packets[:, 0] = 0x47
        packets[:, 1] = DATA_PID >> 8
        packets[:, 2] = DATA_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(count)) & 15
        counter += count
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        stuffing = max(0, 176 - n) if count == 1 else 0
        clock = max(0, pts - TICKS)
        packets[0, 4 : 12 + stuffing] = 0xFF
        packets[0, 4:6] = [7 + stuffing, 0x10 | 0x40 * entry]
        packets[0, 6:12] = [clock >> 25 & 255, clock >> 17 & 255, clock >> 9 & 255, clock >> 1 & 255, (clock & 1) << 7 | 0x7E, 0]
        packets[0, 12 + stuffing :] = body[: 176 - stuffing]
        if count > 2:
            packets[1:-1, 4:] = body[176 : 176 + 184 * (count - 2)].reshape(-1, 184)
        if count > 1:
            rest = body[176 + 184 * (count - 2) :]
            gap = 184 - len(rest)
            if gap:
                packets[-1, 3] |= 0x20
                packets[-1, 4 : 4 + gap] = 0xFF
                packets[-1, 4] = gap - 1
                if gap > 1:
                    packets[-1, 5] = 0
            packets[-1, 4 + gap :] = rest
        out.append(packets)
    return b"".join(x.tobytes() for x in out)


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes = b""
    program: int = 0
    pid: int = 0
    stream_type: int = 0
    packets: int = 0
    continuity_errors: int = 0
    pts: list[int] = field(default_factory=list)
    #: Offsets in payload of the units that are random-access points.
    entry_points: list[int] = field(default_factory=list)

    def feature(self) -> str:
        return f"program={self.program};pid={self.pid};type={self.stream_type};packets={self.packets};units={len(self.pts)};entries={len(self.entry_points)};cc_errors={self.continuity_errors};pts={self.pts[0] if self.pts else ''}-{self.pts[-1] if self.pts else ''}"


def _whole_sections(rows: np.ndarray, start: np.ndarray, table: int) -> list[bytes]:
    """Bodies of the sections of a table in packets (rows) with payloads from start on."""
    found, held = [], None

    def take(raw: bytes) -> bytes | None:
        """Whole sections off the front; what is left waits for the next packet (None: stuffing)."""
        while raw and raw[0] != 0xFF:
            length = 3 + ((raw[1] & 15) << 8 | raw[2]) if len(raw) >= 3 else len(raw) + 1
            if len(raw) < length:
                return raw
            if raw[0] != table or length < 12 or crc_mpeg(raw[:length]):
                raise ValueError(f"section of table {table} is damaged")
            found.append(raw[8 : length - 4])
            raw = raw[length:]
        return None

    for row, at in zip(rows, start.tolist(), strict=True):
        raw = row[at:].tobytes()
        if row[1] & 0x40:
            if not raw or len(raw) <= raw[0]:
                raise ValueError(f"section of table {table} is damaged")
            if held is not None and take(held + raw[1 : 1 + raw[0]]) is not None:
                raise ValueError(f"section of table {table} is damaged")
            held = take(raw[1 + raw[0] :])
        elif held is not None:
            held = take(held + raw)
    if held is not None or not found:
        raise ValueError(f"section of table {table} is damaged" if found or held else f"no packet of table {table}")
    return found


def _table(rows: np.ndarray, start: np.ndarray, table: int, known: dict) -> bytes:
    """The body that all sections of a table agree on. known: bodies by the bytes of single packets."""
    if len(rows) and (rows[:, 1] & 0x40).all() and (rows[:, 4:] == rows[0, 4:]).all():
        # Copies of one packet: one of them tells all.
        key = (table, int(start[0]), rows[0, 4:].tobytes())
        if key not in known:
            known[key] = _whole_sections(rows[:1], start[:1], table)
        found = known[key]
    else:
        found = _whole_sections(rows, start, table)
    if any(x != found[0] for x in found):
        raise ValueError(f"table {table} changes within the stream")
    return found[0]


def _entries(body: bytes) -> list[tuple[int, int]]:
    """(program, packet identifier) of an association table."""
    return [(body[i] << 8 | body[i + 1], (body[i + 2] & 31) << 8 | body[i + 3]) for i in range(0, len(body) - 3, 4)]


def demux(media: bytes, known: dict | None = None) -> Stream:
    """Read the first stream of the first program of a transport stream.

    known: parsed program tables by their packets' bytes, which streams have in common.
    """
    known = {} if known is None else known
    if not media or len(media) % 188:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, 188)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    if (packets[:, 1] & 0x80).any() or (packets[:, 3] & 0xC0).any():
        raise ValueError("packets are flagged as damaged or scrambled")
    out = Stream(packets=len(packets))
    pids = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    # Packets by identifier, in order; the counter runs over those with payload.
    order = np.argsort(pids, kind="stable")
    order = order[(packets[order, 3] & 0x10 != 0) & (pids[order] != 0x1FFF)]
    pids, packets = pids[order], packets[order]
    field_ = packets[:, 3] & 0x20 != 0
    start = np.where(field_, 5 + packets[:, 4].astype(np.int32), 4)
    if len(start) and start.max() > 188:
        raise ValueError("damaged adaptation field")
    counter, same = packets[:, 3] & 15, pids[1:] == pids[:-1]
    repeats = np.zeros(len(packets), bool)
    again = np.flatnonzero(same & (counter[1:] == counter[:-1])) + 1
    repeats[again] = (packets[again, 4:] == packets[again - 1, 4:]).all(axis=1)
    thrice = repeats[1:] & repeats[:-1]
    told = field_ & (packets[:, 4] > 0) & (packets[:, 5] & 0x80 != 0)
    broken = same & ~repeats[1:] & ((counter[1:] - counter[:-1]) % 16 != 1) & ~told[1:]
    out.continuity_errors = int(broken.sum() + thrice.sum())
    kept = ~repeats
    pids, packets, start, field_ = pids[kept], packets[kept], start[kept], field_[kept]

    def of(pid: int) -> slice:
        return slice(*np.searchsorted(pids, [pid, pid + 1]).tolist())

    own = of(PAT_PID)
    programs = [e for e in _entries(_table(packets[own], start[own], 0, known)) if e[0]]
    if not programs:
        raise ValueError("no program")
    out.program, map_pid = programs[0]
    own = of(map_pid)
    pmt = _table(packets[own], start[own], 2, known)
    skip = 4 + ((pmt[2] & 15) << 8 | pmt[3])
    if len(pmt) < skip + 5:
        raise ValueError("no elementary stream")
    out.stream_type, out.pid = pmt[skip], (pmt[skip + 1] & 31) << 8 | pmt[skip + 2]
    own = of(out.pid)
    mine, begin, field_ = packets[own], start[own], field_[own]
    unit = mine[:, 1] & 0x40 != 0
    entry = unit & field_ & (mine[:, 4] > 0) & (mine[:, 5] & 0x40 != 0)
    stream = mine[np.arange(188) >= begin[:, None]]
    ends = np.cumsum(188 - begin)
    heads = np.flatnonzero(unit)
    if not len(heads) or heads[0] != 0:
        raise ValueError("no start of an elementary packet")
    cut = np.append(ends[heads] - (188 - begin[heads]), ends[-1])
    parts, size = [], 0
    for k, head in enumerate(heads.tolist()):
        raw = stream[cut[k] : cut[k + 1]].tobytes()
        if len(raw) < 9 or raw[:3] != b"\0\0\1":
            raise ValueError("damaged elementary packet")
        # A length of 0 leaves the end open, up to the next start.
        stop = 6 + (raw[4] << 8 | raw[5]) if raw[4] or raw[5] else len(raw)
        if not 9 + raw[8] <= stop <= len(raw):
            raise ValueError("damaged elementary packet")
        if raw[7] & 0x80 and raw[8] >= 5:
            t = raw[9:14]
            out.pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
        if entry[head]:
            out.entry_points.append(size)
        parts.append(raw[9 + raw[8] : stop])
        size += len(parts[-1])
    out.payload = b"".join(parts)
    return out


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of docs(doc_id, text): the padded UTF-8 text as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.stack([_table_packet(p, s) for p, s in zip((PAT_PID, PMT_PID), program_sections(), strict=True)])
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            raw, at = memoryview(data), 0
            while at < len(batch):
                stop, media, size = at, [], 0
                while stop < len(batch) and size < 4 << 20:
                    media.append(mux(pad(bytes(raw[offsets[stop] : offsets[stop + 1]])), tables))
                    size += len(media[-1])
                    stop += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.array(np.diff(offsets[at : stop + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                at = stop

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


READ = "payload binary, program int, pid int, stream_type int, packets long, continuity_errors long, pts array<long>, entry_points array<long>"


def read(stored: DataFrame) -> DataFrame:
    """Rows of stored(media, ...) with what demux() finds, as columns payload ... entry_points."""
    names = [x.split()[0] for x in READ.split(", ")]
    kept = [c for c in stored.columns if c != "media"]
    called = [f"stored_{c}" if c in names else c for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            found = [None if m is None else demux(m, known) for m in (x.as_py() for x in batch.column("media"))]
            values = [[None if s is None else getattr(s, n) for s in found] for n in names]
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], [*called, *names])

    schema = ", ".join(f"`{name}` {stored.schema[c].dataType.simpleString()}" for c, name in zip(kept, called, strict=True))
    return stored.select(*kept, "media").mapInArrow(run, f"{schema + ', ' if kept else ''}{READ}")


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and digests of what is read back from stored(doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            rows = []
            for m in batch.column(2):
                media = m.as_py()
                if media is None:
                    rows.append((None,) * 6)
                    continue
                s = demux(media, known)
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), s.feature()))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
