"""Packet captures (pcap and pcapng) as a source: one row per frame, readable or with a reason. A file that cannot be read
(on) gives a row with the reason at that place, so no file and no tail vanishes.

A capture has no marks to find a record by, so ``capture_ranges`` first walks the record lengths of each file, without
looking at the packets, and cuts it into ranges of records; ``read_captures`` then decodes the ranges in parallel. A file
may have any size: a task holds a buffer while it walks and one batch of rows while it decodes.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PACKET_SCHEMA
from .tables import located, staging_dir, write_stage

BATCH = 20_000
#: Bytes of an Arrow batch of whole captures, about.
BATCH_BYTES = 4 << 20
COLUMNS = [f.name for f in PACKET_SCHEMA] + ["reason"]
SCHEMA = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in PACKET_SCHEMA) + ", reason string"


#: Bytes of a range, about; and what a walk reads at once.
RANGE_BYTES, BUFFER = 64 << 20, 1 << 20
RANGES = "file string, begin long, end long, first long, state string"
#: Frames of the n-th file of a link are numbered from n times this.
FILE_STEP = 1 << 40


def store_captures(files: DataFrame, folder: str) -> None:
    """Writes (name, content) rows as files; a repeated task writes the same file again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = located(folder)
        system.create_dir(base, recursive=True)
        for b in batches:
            for name, content in zip(b["name"], b["content"]):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"files": [len(b)]})

    files.select("name", "content").mapInPandas(run, "files long").agg(F.sum("files")).collect()


class Memory:
    """A capture in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def at(self, offset: int, n: int) -> bytes:
        return self.data[offset:offset + n]


class Stored:
    """A capture in a file, read through a buffer; any file system that pyarrow knows."""

    def __init__(self, path: str):
        system, name = located(path)
        self.file, self.start, self.held = system.open_input_file(name), 0, b""
        self.size = self.file.size()

    def at(self, offset: int, n: int) -> bytes:
        if offset < self.start or offset + n > self.start + len(self.held):
            self.file.seek(offset)
            self.start, self.held = offset, self.file.read(max(n, BUFFER))
        return self.held[offset - self.start:offset - self.start + n]


def capture_ranges(spark: SparkSession, path: str, pattern: str = "*.pcap*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of whole records of all files below ``path``: where they begin and end, the number of their first frame, and
    what a decoder has to know there (byte order, clock, link types)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["path"]:
                source = Stored(name)
                state, at, reason = _start(source)
                if reason:
                    yield pd.DataFrame([(name, 0, source.size, 0, None)], columns=[x.split()[0] for x in RANGES.split(", ")])
                    continue
                begin, first, count, known = at, 0, 0, json.dumps(state)
                out = []
                for after, frame in _records(source, state, at, source.size, bodies=False):
                    count += frame is not None
                    if after - begin >= range_bytes:
                        out.append((name, begin, after, first, known))
                        begin, first, known = after, count, json.dumps(state)
                if begin < source.size:
                    out.append((name, begin, source.size, first, known))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in RANGES.split(", ")])

    listed = spark.read.parquet(write_stage(files, staging_dir(spark, "capture_files")))
    return listed.repartition("path").mapInPandas(run, RANGES)


def read_captures(spark: SparkSession, path: str, pattern: str = "*.pcap*", link: Column | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of all captures below ``path`` with their ``file``.

    ``link``: what one capture point is called, from ``file``; rotated files of one link then have one ``capture``, so
    that a flow over two of them is one flow. Without it every file is a capture of its own. Frames are numbered through
    the files of a link in the order of their names."""
    ranges = spark.read.schema(RANGES).parquet(write_stage(capture_ranges(spark, path, pattern, range_bytes), staging_dir(spark, "capture_ranges")))
    named = ranges.withColumn("capture", F.col("file") if link is None else link)
    files = named.select("capture", "file").distinct()
    files = files.withColumn("number", F.row_number().over(Window.partitionBy("capture").orderBy("file")) - 1)
    dealt = named.join(files.select("file", "number"), "file").repartition("file", "begin")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for b in batches:
            for r in b.itertuples(index=False):
                source = Stored(r.file)
                frames = _frames(source, json.loads(r.state), r.begin, r.end) if r.state else _frames(source)
                for i, frame in enumerate(frames, r.number * FILE_STEP + r.first):
                    rows.append((r.capture, i, *_packet(*frame), r.file))
                    if len(rows) >= BATCH:
                        yield _frame_table(rows, [*COLUMNS, "file"])
                        rows = []
        if rows:
            yield _frame_table(rows, [*COLUMNS, "file"])

    return dealt.mapInPandas(run, SCHEMA + ", file string")


def decode(files: DataFrame) -> DataFrame:
    """(capture, content) to frames; ``reason`` is set, and packet fields are NULL, for unreadable frames.

    One capture at a time is taken out of its Arrow batch, and batches are cut by their bytes, not by rows alone: a worker
    holds BATCH_BYTES, one capture and BATCH frames, however long the captures of a table are."""

    import pyarrow as pa

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    out_schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in PACKET_SCHEMA] + [("reason", pa.string())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), out_schema)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for name, content in zip(b.column("capture"), b.column("content")):
                name = name.as_py()
                for i, frame in enumerate(_frames(Memory(content.as_py()))):
                    rows.append((name, i, *_packet(*frame)))
                    if len(rows) >= BATCH:
                        yield table(rows)
                        rows = []
            del b  # before the next batch is read
        if rows:
            yield table(rows)

    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return files.select("capture", "content").mapInArrow(run, SCHEMA)


def packets(decoded: DataFrame) -> DataFrame:
    return decoded.where("reason IS NULL").drop("reason")


def malformed(decoded: DataFrame) -> DataFrame:
    return decoded.where("reason IS NOT NULL").select("capture", "index", "reason")


def _frame_table(rows: list[tuple], columns: list[str] = COLUMNS) -> pd.DataFrame:
    text = ("capture", "src_ip", "dst_ip", "reason", "file")
    return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns if c not in text})


def _frames(source, state: dict | None = None, begin: int = 0, end: int | None = None) -> Iterator[tuple]:
    """(timestamp_us, link type, frame bytes, reason) in file order; with a reason where the file itself cannot be read on."""
    if state is None:
        state, begin, reason = _start(source)
        if reason:
            yield None, None, b"", reason
            return
    for _, frame in _records(source, state, begin, source.size if end is None else end):
        if frame is not None:
            yield frame


# File magic, byte order and clock ticks per microsecond.
_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
_SECTION = b"\x0a\x0d\x0d\x0a"


def _start(source) -> tuple[dict | None, int, str | None]:
    """What holds at the first record, where that is, or why the file cannot be read."""
    magic = source.at(0, 4)
    if magic == _SECTION:
        return {"blocks": True, "order": "<", "links": []}, 0, None
    if magic not in _MAGIC:
        return None, 0, "file: unknown magic"
    if source.size < 24:
        return None, 0, "file: header cut short"
    order, unit = _MAGIC[magic]
    return {"blocks": False, "order": order, "unit": unit, "link": struct.unpack(order + "I", source.at(20, 4))[0] & 0xFFFF}, 24, None


def _records(source, state: dict, at: int, end: int, bodies: bool = True) -> Iterator[tuple[int, tuple | None]]:
    """(offset behind it, frame or None where a block holds none) of each record; ``state`` is kept up to date.

    Without ``bodies`` packets are passed over by their lengths, and frames come without their bytes."""
    if state["blocks"]:
        yield from _blocks(source, state, at, end, bodies)
        return
    order, unit, link = state["order"], state["unit"], state["link"]
    while at < end:
        head = source.at(at, 16)
        if len(head) < 16:
            yield source.size, (None, link, head, "record: header cut short")
            return
        sec, frac, size, _ = struct.unpack(order + "IIII", head)
        whole = at + 16 + size <= source.size
        frame = source.at(at + 16, size) if bodies else b""
        at += 16 + size
        yield at, (sec * 1_000_000 + (frac + unit // 2) // unit, link, frame, None if whole else "record: data cut short")


#: Pcapng blocks that carry no packet (section, interface, names, statistics, journal, secrets, custom).
_NO_PACKET = {0x0A0D0D0A, 1, 4, 5, 9, 10, 0x0BAD, 0x40000BAD}


def _blocks(source, state: dict, at: int, end: int, bodies: bool) -> Iterator[tuple[int, tuple | None]]:
    while at < end:
        head = source.at(at, 12)
        if len(head) < 12:
            yield source.size, (None, None, b"", "block: header cut short")
            return
        if head[:4] == _SECTION:
            state["order"], state["links"] = ("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        order, links = state["order"], state["links"]
        kind, size = struct.unpack(order + "II", head[:8])
        if size < 12 or at + size > source.size:
            yield source.size, (None, None, b"", "block: wrong length" if size < 12 else "block: data cut short")
            return
        body = source.at(at + 8, size - 12) if bodies or kind == 1 else b""
        at, found = at + size, None
        if kind == 1 and len(body) >= 8:
            links.append((struct.unpack(order + "H", body[:2])[0], _ticks(body[8:], order), struct.unpack(order + "I", body[4:8])[0]))
        elif kind in (2, 3, 6) and not bodies:
            found = (None, None, b"", None)
        elif kind in (2, 6) and len(body) >= 20:
            if kind == 6:
                iface, high, low, cap = struct.unpack(order + "IIII", body[:16])
            else:
                iface, _, high, low, cap = struct.unpack(order + "HHIII", body[:16])
            link, per_sec, _ = links[iface] if iface < len(links) else (1, 1_000_000, 0)
            ticks, frame = (high << 32) | low, body[20:20 + cap]
            found = ((ticks * 1_000_000 + per_sec // 2) // per_sec, link, frame, None if len(frame) == cap else "record: data cut short")
        elif kind == 3 and len(body) >= 4:  # a packet without a time: as long as stated, or as the interface keeps
            link, _, snap = links[0] if links else (1, 1_000_000, 0)
            size_on_wire = struct.unpack(order + "I", body[:4])[0]
            found = (None, link, body[4:4 + (min(size_on_wire, snap) if snap else size_on_wire)], "packet without a time")
        elif kind not in _NO_PACKET:
            found = (None, None, b"", f"block: unknown kind {kind}")
        yield at, found


def _ticks(options: bytes, order: str) -> int:
    """Clock ticks per second of an interface (option 9), a million if not stated."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at:at + 4])
        if code == 0:
            break
        if code == 9 and size:
            v = options[at + 4]
            return 2 ** (v & 0x7F) if v & 0x80 else 10**v
        at += 4 + size + (-size % 4)
    return 1_000_000


def _bad(ts: int | None, reason: str) -> tuple:
    return (ts, *[None] * 11, reason)


# The reasons of unreadable frames.
def _packet(ts: int | None, link: int | None, frame: bytes, reason: str | None = None) -> tuple:
    """Fields of one frame in the order of the packet table, then the reason if it cannot be read."""
    if reason:
        return _bad(ts, reason)
    if link == 1:
        if len(frame) < 14:
            return _bad(ts, "Truncated link header.")
        kind, at = struct.unpack("!H", frame[12:14])[0], 14
        while kind in (0x8100, 0x88A8) and len(frame) >= at + 4:
            kind, at = struct.unpack("!H", frame[at + 2:at + 4])[0], at + 4
    elif link in (101, 228, 229):
        kind, at = (0x86DD if frame[:1] and frame[0] >> 4 == 6 else 0x0800), 0
    else:
        return _bad(ts, f"Unsupported link type {link}.")
    if kind == 0x86DD:
        return _bad(ts, "IPv6 packet - only IPv4 flows are supported.")
    if kind != 0x0800:
        return _bad(ts, "No IPv4 layer present (e.g. ARP or other non-IP frame).")
    ip = frame[at:]
    if len(ip) < 20:
        return _bad(ts, "Truncated IPv4 header.")
    head = (ip[0] & 15) * 4 or 20
    total = struct.unpack("!H", ip[2:4])[0] or len(frame)
    proto = ip[9]
    src, dst = ".".join(map(str, ip[12:16])), ".".join(map(str, ip[16:20]))
    fragment = struct.unpack("!H", ip[6:8])[0] & 0x1FFF
    sport = dport = flags = window = None
    transport, seg = 0, ip[head:]
    if proto == 6 and fragment == 0 and len(seg) >= 20:
        sport, dport = struct.unpack("!HH", seg[:4])
        transport, flags, window = (seg[12] >> 4) * 4 or 20, seg[13], struct.unpack("!H", seg[14:16])[0]
    elif proto == 17 and fragment == 0 and len(seg) >= 8:
        sport, dport = struct.unpack("!HH", seg[:4])
        transport = 8
    return (ts, src, dst, sport, dport, proto, total, head, transport, max(0, total - head - transport), flags, window, None)
