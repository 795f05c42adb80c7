"""Capture files to packet tables and back.

Captures have no marks to split at, so a first pass hops from record to record, reading headers only, and notes where
blocks of about ``BLOCK_BYTES`` begin; a second pass reads the blocks of all captures side by side, in Arrow batches. Memory
depends on a block, not on the capture, which may be of any size. Files are opened through Arrow's file systems (local,
HDFS, S3, GCS, Azure); from any other store Spark reads a capture whole, one task each (``whole=True``).

Both byte orders, microsecond and nanosecond stamps, the newer block format (pcapng) with its interfaces and resolutions,
Ethernet with VLAN tags, Linux cooked, loopback and raw IP frames are read; packets other than IPv4 are skipped. A packet
keeps its place in the file as ``pkt_no``, which orders everything after. With ``raw`` it also keeps its link type and its
time in whole nanoseconds, so that what is written is what was read.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = [
    ("pcap", pa.string()), ("pkt_no", pa.int64()), ("ts_s", pa.float64()), ("src_ip", pa.string()), ("dst_ip", pa.string()), ("src_port", pa.int32()), ("dst_port", pa.int32()),
    ("proto", pa.int32()), ("length", pa.int32()), ("tcp_flags", pa.int32()), ("header_length", pa.int32()), ("payload_length", pa.int32()), ("window", pa.int32()),
]
RAW_FIELDS = [("raw", pa.binary()), ("link", pa.int32()), ("ts_ns", pa.int64())]
SCHEMA = pa.schema([*FIELDS, *RAW_FIELDS])
_SQL = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary"}
DDL = ", ".join(f"{n} {_SQL[t]}" for n, t in [*FIELDS, *RAW_FIELDS])

#: First four bytes of a file: byte order and nanoseconds a tick.
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1000), b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1)}
NG = b"\x0a\x0d\x0d\x0a"
NG_ORDER = {b"\x1a\x2b\x3c\x4d": ">", b"\x4d\x3c\x2b\x1a": "<"}
SECTION, INTERFACE, OLD_PACKET, SIMPLE, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
ETHERNET, LOOPBACK, RAW, COOKED = 1, 0, (12, 14, 101, 228), 113
IPV4, VLAN = 0x0800, (0x8100, 0x88A8)
TCP, UDP, SCTP = 6, 17, 132
BLOCK_BYTES, ROWS = 64 << 20, 10_000
#: Schemes that Arrow opens.
ARROW = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def _ip_start(frame: bytes, link: int) -> int | None:
    """Where the IPv4 header starts."""
    if link == ETHERNET:
        at = 12
        while len(frame) >= at + 2:
            kind = int.from_bytes(frame[at : at + 2], "big")
            if kind not in VLAN:
                return at + 2 if kind == IPV4 else None
            at += 4
        return None
    if link in RAW:
        return 0
    if link == COOKED:
        return 16 if frame[14:16] == b"\x08\x00" else None
    return 4 if link == LOOPBACK else None


def _fields(frame: bytes, link: int) -> tuple | None:
    """(src_ip, dst_ip, src_port, dst_port, proto, flags, header, payload, window); ports are 0 where there are none.

    ``header`` counts the bytes of the transport header, ``payload`` those that the IP length leaves after it.
    """
    at = _ip_start(frame, link)
    if at is None or len(frame) < at + 20 or frame[at] >> 4 != 4:
        return None
    size, proto = (frame[at] & 15) * 4, frame[at + 9]
    inside = max(0, int.from_bytes(frame[at + 2 : at + 4], "big") - size)
    src, dst = (".".join(map(str, frame[at + k : at + k + 4])) for k in (12, 16))
    first = int.from_bytes(frame[at + 6 : at + 8], "big") & 0x1FFF == 0
    body = frame[at + size :]
    if not first or proto not in (TCP, UDP, SCTP) or len(body) < 4:
        return src, dst, 0, 0, proto, None, None, inside, None
    flags = header = window = None
    if proto == TCP and len(body) > 15:
        header, flags, window = (body[12] >> 4) * 4, body[13], int.from_bytes(body[14:16], "big")
    elif proto == TCP and len(body) > 13:
        header, flags = (body[12] >> 4) * 4, body[13]
    elif proto != TCP:
        header = 8 if proto == UDP else 12
    return src, dst, *struct.unpack(">HH", body[:4]), proto, flags, header, max(0, inside - (header or 0)), window


class Records:
    """Records of a capture, one after the other, from where ``state`` says; ``state`` is JSON that another task can go on
    from."""

    def __init__(self, name: str, stream: BinaryIO, state: str | None = None):
        self.name, self.stream = name, stream
        if state is not None:
            self.__dict__.update(json.loads(state))
            self.stream.seek(self.at)
            return
        self.at = self.number = 0
        self.interfaces: list[tuple[int, int]] = []  # (link, ticks a second) of this section
        magic = stream.read(4)
        self.ng = magic == NG
        if self.ng:
            stream.seek(0)
            self.order = "<"
        elif magic in MAGIC:
            self.order, tick = MAGIC[magic]
            head = stream.read(20)
            self.interfaces = [(struct.unpack(f"{self.order}I", head[16:20])[0] & 0xFFFF if len(head) == 20 else ETHERNET, 1_000_000_000 // tick)]
            self.at = 24
        else:
            raise ValueError(f"{name}: not a capture file")

    def state(self) -> str:
        return json.dumps({k: v for k, v in self.__dict__.items() if k not in ("name", "stream")})

    def next(self, frames: bool = True) -> tuple[int, int, int, int, bytes] | None:
        """(number, nanoseconds, link, bytes kept, frame) of the next record; a record that is cut off ends the file.

        Without ``frames`` the frame is passed over and empty.
        """
        return self._next_block(frames) if self.ng else self._next_record(frames)

    def _take(self, n: int, frames: bool) -> bytes | None:
        if frames:
            out = self.stream.read(n)
            return out if len(out) == n else None
        self.stream.seek(n, io.SEEK_CUR)
        return b""

    def _next_record(self, frames: bool) -> tuple[int, int, int, int, bytes] | None:
        head = self.stream.read(16)
        if len(head) < 16:
            return None
        sec, frac, kept, _ = struct.unpack(f"{self.order}IIII", head)
        if (frame := self._take(kept, frames)) is None:
            return None
        link, ticks = self.interfaces[0]
        out = self.number, sec * 1_000_000_000 + frac * (1_000_000_000 // ticks), link, kept, frame
        self.at, self.number = self.at + 16 + kept, self.number + 1
        return out

    def _next_block(self, frames: bool) -> tuple[int, int, int, int, bytes] | None:
        while True:
            head = self.stream.read(12)
            if len(head) < 12:
                return None
            if head[:4] == NG:
                self.order, self.interfaces = NG_ORDER.get(head[8:12], "<"), []
            kind, size = struct.unpack(f"{self.order}II", head[:8])
            if size < 12 or size % 4:
                return None
            rest, found = size - 12, None
            if kind == INTERFACE:
                body, rest = head[8:12] + self.stream.read(rest), 0
                self.interfaces.append((struct.unpack(f"{self.order}H", body[:2])[0], self._resolution(body[8:-4])))
            elif kind in (PACKET, OLD_PACKET):
                body = head[8:12] + self.stream.read(16)
                rest -= 16
                which, high, low, kept = struct.unpack(f"{self.order}IIII", body[:16])
                which = which if kind == PACKET else struct.unpack(f"{self.order}H", body[:2])[0]
                if len(body) < 20 or (frame := self._take(kept, frames)) is None:
                    return None
                rest -= kept
                link, ticks = self.interfaces[which] if which < len(self.interfaces) else (ETHERNET, 1_000_000)
                found = self.number, ((high << 32) + low) * 1_000_000_000 // ticks, link, kept, frame
            elif kind == SIMPLE:  # no time
                kept = min(struct.unpack(f"{self.order}I", head[8:12])[0], rest - 4)
                if (frame := self._take(kept, frames)) is None:
                    return None
                rest -= kept
                found = self.number, 0, self.interfaces[0][0] if self.interfaces else ETHERNET, kept, frame
            self.stream.seek(rest, io.SEEK_CUR)
            self.at += size
            if found:
                self.number += 1
                return found

    def _resolution(self, options: bytes) -> int:
        """Ticks a second, from an interface's options."""
        at = 0
        while at + 4 <= len(options):
            code, n = struct.unpack(f"{self.order}HH", options[at : at + 4])
            if code == 0:
                break
            if code == 9 and n:
                value = options[at + 4]
                return 2 ** (value & 127) if value & 128 else 10**value
            at += 4 + n + -n % 4
        return 1_000_000


def rows(records: Records, end: int | None = None) -> Iterator[dict]:
    """Packet rows of the records that begin before ``end``."""
    while (end is None or records.at < end) and (record := records.next()):
        number, ns, link, kept, frame = record
        if found := _fields(frame, link):
            src, dst, sport, dport, proto, flags, header, payload, window = found
            yield {"pcap": records.name, "pkt_no": number, "ts_s": ns // 1_000_000_000 + ns % 1_000_000_000 / 1e9, "src_ip": src, "dst_ip": dst, "src_port": sport, "dst_port": dport, "proto": proto, "length": kept, "tcp_flags": flags, "header_length": header, "payload_length": payload, "window": window, "raw": frame, "link": link, "ts_ns": ns}


def parse(name: str, content: bytes) -> Iterator[dict]:
    """Packet rows of one file in memory."""
    return rows(Records(name, io.BytesIO(content)))


def _batches(found: Iterator[dict], with_raw: bool) -> Iterator[pa.RecordBatch]:
    held = []
    for row in found:
        held.append(row if with_raw else row | {"raw": None})
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, SCHEMA)


def _opened(path: str) -> BinaryIO:
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":  # paths are plain, not escaped
        return fs.LocalFileSystem().open_input_file(f"/{rest.lstrip('/')}")
    store, at = fs.FileSystem.from_uri(quote(f"s3:{rest}" if scheme == "s3a" else path, safe=":/@%"))
    return store.open_input_file(at)


def _name(path: str) -> str:
    return path.rpartition("/")[2]


def _indexed(block: int):
    """Paths to blocks (path, state, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _opened(path) as raw:
                    records = Records(_name(path), io.BufferedReader(raw, 1 << 20))
                    begin, state = records.at, records.state()
                    more = True
                    while more:
                        more = records.next(frames=False) is not None
                        if not more or records.at - begin >= block:
                            yield pa.RecordBatch.from_pylist([{"path": path, "state": state, "end": records.at}])
                            begin, state = records.at, records.state()

    return run


def _read_blocks(with_raw: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as raw:
                    yield from _batches(rows(Records(_name(row["path"]), io.BufferedReader(raw, 1 << 20), row["state"]), row["end"]), with_raw)

    return run


def _read_whole(with_raw: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(parse(_name(path), content.as_py()), with_raw)

    return run


def captures(spark: SparkSession, path: str, glob: str = "cap*") -> DataFrame:
    """Files that are read as captures."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).filter(~F.col("path").endswith(".csv"))


def read(spark: SparkSession, path: str, glob: str = "cap*", with_raw: bool = False, whole: bool | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """Packets of the captures under ``path``; ``raw``, ``link`` and ``ts_ns`` only if asked for."""
    files = captures(spark, path, glob)
    if whole is None:
        scheme = path.partition("://")[0] if "://" in path else spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").partition(":")[0]
        whole = scheme not in ARROW
    if whole:
        df = files.select("path", "content").mapInArrow(_read_whole(with_raw), DDL)
    else:
        blocks_of = files.select("path").repartition(F.col("path")).mapInArrow(_indexed(block), "path string, state string, end long")
        df = blocks_of.repartition("path", "end").mapInArrow(_read_blocks(with_raw), DDL)
    return df if with_raw else df.drop(*[n for n, _ in RAW_FIELDS])


def encode(records: list[tuple[float, bytes]], link: int = ETHERNET) -> bytes:
    """A capture file of (time, frame) records, times in microseconds."""
    return encode_ns([(round(ts * 1e6) * 1000, frame) for ts, frame in records], link)


def encode_ns(records: list[tuple[int, bytes]], link: int = ETHERNET) -> bytes:
    """A capture file of (nanoseconds, frame) records; stamps are nanoseconds only where microseconds would lose some."""
    tick = 1 if any(ns % 1000 for ns, _ in records) else 1000
    parts = [struct.pack("<IHHiIII", 0xA1B23C4D if tick == 1 else 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, link)]
    for ns, frame in records:
        parts.append(struct.pack("<IIII", ns // 1_000_000_000, ns % 1_000_000_000 // tick, len(frame), len(frame)) + frame)
    return b"".join(parts)


def blocks(packets: DataFrame, keys: tuple[str, ...] = ("phase", "pcap"), size: int = 100_000) -> DataFrame:
    """(keys, link, block, content): packets with ``raw`` as capture files of at most ``size`` packets of one link type, in
    order of ``pkt_no``.

    They replace one file a phase and capture, without a task that holds a whole capture.
    """
    dealt = packets.withColumn("block", F.floor(F.col("pkt_no") / size).cast("int")).select(*keys, "link", "block", "pkt_no", "ts_ns", "raw")
    found = F.array_sort(F.collect_list(F.struct("pkt_no", "ts_ns", "raw")))
    grouped = dealt.groupBy(*keys, "link", "block").agg(found.alias("rows"))
    types = [f"`{k}` {packets.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links, lists = b.column(len(keys)).to_pylist(), b.column(len(keys) + 2).to_pylist()
            content = [encode_ns([(r["ts_ns"], r["raw"]) for r in found], link) for link, found in zip(links, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys) + 2], pa.array(content, pa.binary())], [*keys, "link", "block", "content"])

    return grouped.mapInArrow(run, ", ".join([*types, "link int", "block int", "content binary"]))


def write(packets: DataFrame, folder: str, size: int = 100_000) -> DataFrame:
    """Writes ``p_<phase>_<capture>`` files under ``folder`` / ``phase_<phase>``, several with a number each where a capture
    has more packets than ``size`` or several link types. Returns (phase, path).

    A file is written beside its name and then moved, so a lost task leaves no half of one; ``folder`` is of a store that
    Arrow opens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            done = []
            for r in b.to_pylist():
                store, top = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                end = "" if r["block"] == 0 and r["link"] == ETHERNET else f".{r['link']}.{r['block']:06d}"
                at = f"{top}/phase_{r['phase']}/p_{r['phase']}_{r['pcap']}{end}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{at}.writing") as out:
                    out.write(r["content"])
                store.move(f"{at}.writing", at)
                done.append({"phase": r["phase"], "path": at})
            if done:
                yield pa.RecordBatch.from_pylist(done, pa.schema([("phase", pa.int32()), ("path", pa.string())]))

    return blocks(packets, ("phase", "pcap"), size).mapInArrow(run, "phase int, path string")
