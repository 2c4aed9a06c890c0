"""Capture files as a Spark data source (``pcap``), for reading, streaming and writing.

Classic captures in both byte orders with micro- or nanoseconds, and pcapng. A path is a file, a
directory or a pattern of names in one, local or on any file system that Arrow knows by its URI
(``hdfs://``, ``s3://``, ``gs://``); a file is one partition and is read in one pass with bounded
memory, as records can only be found one after the other. The position of a packet in its file is ``pkt_no``; with several files, files follow each other in the
order of their names with a distance of 2**40.
"""

from __future__ import annotations

import io
import struct
import time
from collections.abc import Iterator
from fnmatch import fnmatch
from itertools import islice
from os.path import abspath

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..decode.columnar import cut
from ..schemas import RAW_PACKETS

_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
_SECTION = b"\x0a\x0d\x0d\x0a"
BATCH = 10_000
#: Bytes of a file read at once.
CHUNK = 4 << 20
FILE_STRIDE = 1 << 40


class CaptureError(ValueError):
    """A file that is no capture, or ends inside a packet."""


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Where a path or URI is, and its name there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), abspath(path))


def _open(where: fs.FileSystem, name: str) -> io.BufferedReader:
    return io.BufferedReader(where.open_input_file(name), 1 << 20)


def read_packets(path: str, where: fs.FileSystem | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """(ts_usec, link type, wire length, bytes) of each packet."""
    if where is None:
        where, path = file_system(path)
    with _open(where, path) as f:
        head = f.read(24)
        if head[:4] == _SECTION:
            f.seek(0)
            yield from _read_ng(f, path)
            return
        if len(head) < 24 or head[:4] not in _MAGIC:
            raise CaptureError(f"{path}: not a capture file")
        order, per = _MAGIC[head[:4]]
        link = struct.unpack(order + "I", head[20:24])[0] & 0x0FFFFFFF
        record = struct.Struct(order + "IIII")
        while rest := f.read(16):
            if len(rest) < 16:
                raise CaptureError(f"{path}: cut inside a packet header")
            sec, part, kept, wire = record.unpack(rest)
            data = f.read(kept)
            if len(data) < kept:
                raise CaptureError(f"{path}: cut inside a packet")
            yield sec * 1_000_000 + part // per, link, wire, data


def _read_ng(f, path: str) -> Iterator[tuple[int, int, int, bytes]]:
    order, links = "<", []
    while head := f.read(8):
        if len(head) < 8:
            raise CaptureError(f"{path}: cut inside a block")
        if head[:4] == _SECTION:
            magic = f.read(4)
            order = "<" if magic == b"\x4d\x3c\x2b\x1a" else ">"
            size = struct.unpack(order + "I", head[4:])[0]
            f.read(size - 12)
            links = []
            continue
        kind, size = struct.unpack(order + "II", head)
        body = f.read(size - 8)
        if size < 12 or len(body) < size - 8:
            raise CaptureError(f"{path}: cut inside a block")
        body = body[:-4]
        if kind == 1:
            link = struct.unpack_from(order + "H", body)[0]
            resolution, at = 1_000_000, 8
            while at + 4 <= len(body):
                code, n = struct.unpack_from(order + "HH", body, at)
                if code == 0:
                    break
                if code == 9:
                    value = body[at + 4]
                    resolution = 1 << (value & 127) if value & 128 else 10**value
                at += 4 + (n + 3) // 4 * 4
            links.append((link, resolution))
        elif kind == 6:
            which, high, low, kept, wire = struct.unpack_from(order + "IIIII", body)
            link, resolution = links[which]
            yield (high << 32 | low) * 1_000_000 // resolution, link, wire, body[20 : 20 + kept]
        elif kind == 3:
            wire = struct.unpack_from(order + "I", body)[0]
            yield 0, links[0][0], wire, body[4 : 4 + wire]


def write_packets(path: str, packets, link_type: int = 1, snap_len: int = 65535, where: fs.FileSystem | None = None) -> int:
    """Writes (ts_usec, wire length, bytes) as a classic capture in microseconds."""
    n = 0
    if where is None:
        where, path = file_system(path)
    with where.open_output_stream(path, buffer_size=1 << 20) as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snap_len, link_type))
        for ts, wire, data in packets:
            data = data[:snap_len]
            f.write(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(data), wire) + data)
            n += 1
    return n


def _files(where: fs.FileSystem, name: str) -> list[str]:
    """Capture files of a file's, a directory's or a pattern's name, in order."""
    info = where.get_file_info(name)
    if info.type == fs.FileType.File:
        return [name]
    folder, pattern = (name, "*") if info.type == fs.FileType.Directory else (name.rpartition("/")[0], name.rpartition("/")[2])
    found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(i.path for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")) and fnmatch(i.base_name, pattern))


class _File(InputPartition):
    def __init__(self, where: fs.FileSystem, path: str, first: int):
        super().__init__(path)
        self.where, self.path, self.first = where, path, first


_SCHEMA = pa.schema([("pkt_no", pa.int64()), ("ts_usec", pa.int64()), ("link_type", pa.int32()), ("cap_len", pa.int64()), ("wire_len", pa.int64()), ("data", pa.binary())])


def _record(first: int, ts, links, wire, data: pa.Array) -> pa.RecordBatch:
    n = len(data)
    kept = pc.binary_length(data).cast(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(ts, pa.int64()), pa.array(links, pa.int32()), kept, pa.array(wire, pa.int64()), data], schema=_SCHEMA)


def _classic_batches(f, head: bytes, path: str, first: int, snap_len: int) -> Iterator[pa.RecordBatch]:
    """Reads ``CHUNK`` bytes at a time; only the chain of record headers is followed one by one."""
    order, per = _MAGIC[head[:4]]
    link = struct.unpack(order + "I", head[20:24])[0] & 0x0FFFFFFF
    sizes, held = struct.Struct(order + "8xI").unpack_from, b""
    while True:
        more = f.read(CHUNK)
        held += more
        at, places = 0, []
        while at + 16 <= len(held):
            stop = at + 16 + sizes(held, at)[0]
            if stop > len(held):
                break
            places.append(at)
            at = stop
        for k in range(0, len(places), BATCH):
            part = np.array([*places[k : k + BATCH], places[k + BATCH] if k + BATCH < len(places) else at], np.int64)
            fields = np.frombuffer(held, np.uint8)[part[:-1, None] + np.arange(16)].view(order + "u4").astype(np.int64)
            start = part[:-1] + 16
            data = cut(pa.py_buffer(held), start, np.minimum(part[1:], start + snap_len), np.ones(len(start), bool))
            yield _record(first, fields[:, 0] * 1_000_000 + fields[:, 1] // per, np.full(len(start), link), fields[:, 3], data)
            first += len(start)
        held = held[at:]
        if not more:
            if held:
                raise CaptureError(f"{path}: cut inside a packet")
            return


def _batches(part: _File, snap_len: int) -> Iterator[pa.RecordBatch]:
    with _open(part.where, part.path) as f:
        head = f.read(24)
        if len(head) == 24 and head[:4] in _MAGIC:
            yield from _classic_batches(f, head, part.path, part.first, snap_len)
            return
    packets, first = read_packets(part.path, part.where), part.first
    while rows := list(islice(packets, BATCH)):
        ts, links, wire, data = zip(*rows, strict=True)
        yield _record(first, ts, links, wire, pa.array([d[:snap_len] for d in data], pa.binary()))
        first += len(rows)


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.snap_len = options["path"], int(options.get("snaplen", 65535))

    def partitions(self):
        where, name = file_system(self.path)
        files = _files(where, name)
        if not files:
            raise CaptureError(f"{self.path}: no capture file")
        return [_File(where, p, k * FILE_STRIDE) for k, p in enumerate(files)]

    def read(self, partition):
        yield from _batches(partition, self.snap_len)


class PcapStream(DataSourceStreamReader):
    """A directory that captures are moved into; the offset is the number of files taken, by name.

    Executors read the files, one a task. Names of later files have to sort behind those of earlier
    ones. After a restart the first batch takes all files that wait. With a ``speed`` a file is taken
    when its first packet is due: its time after the first file's, divided by the speed; 0 is flat out.
    """

    def __init__(self, options: dict):
        self.path, self.snap_len = options["path"], int(options.get("snaplen", 65535))
        self.at_once = int(options.get("maxfilespertrigger", options.get("maxFilesPerTrigger", 1)))
        self.speed = float(options.get("speed", 0))
        self.taken: int | None = None
        self.began = 0.0
        self.first_times: dict[str, int] = {}

    def _ready(self) -> int:
        where, name = file_system(self.path)
        files = _files(where, name)
        if self.speed <= 0 or not files:
            return len(files)
        self.began = self.began or time.monotonic()
        for p in files:
            if p not in self.first_times:
                self.first_times[p] = next(read_packets(p, where), (0,))[0]
        begin = self.first_times[files[0]]
        due = [(self.first_times[p] - begin) / 1e6 / self.speed <= time.monotonic() - self.began for p in files]
        return due.index(False) if False in due else len(files)

    def initialOffset(self):
        self.taken = 0
        return {"files": 0}

    def latestOffset(self):
        ready = self._ready()
        return {"files": ready if self.taken is None else min(ready, self.taken + self.at_once)}

    def partitions(self, start, end):
        self.taken = end["files"]
        where, name = file_system(self.path)
        return [_File(where, p, k * FILE_STRIDE) for k, p in list(enumerate(_files(where, name)))[start["files"] : end["files"]]]

    def read(self, partition):
        yield from _batches(partition, self.snap_len)

    def commit(self, end):
        pass


class _Written(WriterCommitMessage):
    def __init__(self, name: str, count: int):
        self.name, self.count = name, count


class PcapWriter(DataSourceWriter):
    """One capture for each partition, under temporary names until the job commits."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.link_type, self.snap_len = options["path"], int(options.get("linktype", 1)), int(options.get("snaplen", 65535))
        self.columns = schema.fieldNames()

    def write(self, iterator):
        from pyspark import TaskContext

        where, folder = file_system(self.path)
        where.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.pcap"
        temporary = f"{folder}/.{name}.{context.taskAttemptId()}"
        n = write_packets(temporary, ((r["ts_usec"], r["wire_len"], bytes(r["data"])) for r in iterator), self.link_type, self.snap_len, where)
        return _Written(f"{temporary}\0{folder}/{name}", n)

    def commit(self, messages):
        where, _ = file_system(self.path)
        for m in messages:
            where.move(*m.name.split("\0"))

    def abort(self, messages):
        where, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(m.name.split("\0")[0])


class PcapDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return RAW_PACKETS

    def reader(self, schema):
        return PcapReader(self.options)

    def streamReader(self, schema):
        return PcapStream(self.options)

    def writer(self, schema, overwrite):
        return PcapWriter(self.options, schema, overwrite)


def register(spark) -> None:
    spark.dataSource.register(PcapDataSource)
