"""Large capture files: a Python data source that many tasks read one file with, in batch and as a stream, and a writer.

A capture file has no marks between its records, so a task that starts inside one
must find the next record by itself. It looks for a place well before, from which
plausible record headers follow one another for more bytes than any record can
have, and follows them to its start. Rows are the same for any size of splits.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .frames import MAGICS

SCHEMA = "path string, frame_id long, ts_us long, length int, raw binary"
HEADER, RECORD = 24, 16
#: A file's longest record where its header names none, and the span of time that its records may lie apart from the first.
LONGEST, SPAN_SECONDS = 262_144, 10 * 366 * 86_400


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def capture_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a path, in order."""
    system, inner = _open(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    scheme = path[: path.index(inner)] if inner in path else ""
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class CaptureFile:
    """The records of one file by byte ranges; a file of another kind has none."""

    def __init__(self, path: str, block: int = 4 << 20) -> None:
        system, inner = _open(path)
        self.path, self.block = path, block
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        head = self.file.read_at(min(self.size, HEADER + RECORD), 0)
        magic = struct.unpack_from("<I", head)[0] if len(head) >= HEADER else None
        self.known = magic in MAGICS
        if self.known:
            self.order, self.unit = MAGICS[magic]
            longest = struct.unpack_from(f"{self.order}I", head, 16)[0]
            self.longest = longest if 0 < longest <= LONGEST else LONGEST
            self.first = struct.unpack_from(f"{self.order}I", head, HEADER)[0] if len(head) >= HEADER + 4 else 0
        self.at, self.data = 0, b""

    def close(self) -> None:
        self.file.close()

    def _bytes(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place on, read ahead a block at a time."""
        if at < self.at or at + n > self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(min(max(n, self.block), max(self.size - at, 0)), at) if at < self.size else b""
        return self.data[at - self.at : at - self.at + n]

    def _header(self, at: int) -> tuple[int, int, int, int] | None:
        """A plausible record header at a place: seconds, fraction, bytes kept, bytes on the air."""
        head = self._bytes(at, RECORD)
        if len(head) < RECORD:
            return None
        sec, part, kept, whole = struct.unpack(f"{self.order}IIII", head)
        fits = part < 1_000_000 * self.unit and 0 < kept <= self.longest and kept <= whole <= LONGEST and abs(sec - self.first) <= SPAN_SECONDS
        return (sec, part, kept, whole) if fits else None

    def _starts_chain(self, at: int) -> bool:
        """Whether headers follow one another from here for longer than a record, or up to the end of the file."""
        to = at + self.longest + RECORD
        while at <= to:
            if at >= self.size:
                return at == self.size
            got = self._header(at)
            if got is None:
                # the file may end inside a header
                return self.size - at < RECORD
            at += RECORD + got[2]
            if at > self.size:
                return True  # or inside a packet
        return True

    def next_record(self, at: int) -> int:
        """The first record that starts at a place or after it; the size of the file or more if there is none.

        The search begins well before and walks on: the chain found may begin in
        the payload of one packet, if that holds a capture up to its very end, but
        it is the file's own chain after that packet. And near the end of the file
        a chain from here would be cut short.
        """
        begin = max(HEADER, at - 3 * (self.longest + RECORD))
        place = HEADER if begin <= HEADER else self._search(begin)
        while place < min(at, self.size):
            head = self._bytes(place, RECORD)
            if len(head) < RECORD:
                return self.size
            place += RECORD + struct.unpack_from(f"{self.order}I", head, 8)[0]
        return place

    def _search(self, at: int) -> int:
        while at < self.size:
            data = self._bytes(at, self.longest + 2 * RECORD)
            if len(data) < RECORD:
                break
            view = np.frombuffer(data, dtype=np.uint8)
            n = len(view) - RECORD + 1
            four = np.lib.stride_tricks.sliding_window_view(view, 4)
            sec, part, kept, whole = (np.ascontiguousarray(four[k : k + n]).view(np.dtype("u4").newbyteorder(self.order)).ravel().astype(np.int64) for k in (0, 4, 8, 12))
            likely = (part < 1_000_000 * self.unit) & (kept > 0) & (kept <= self.longest) & (kept <= whole) & (whole <= LONGEST) & (np.abs(sec - self.first) <= SPAN_SECONDS)
            for i in np.flatnonzero(likely).tolist():
                if self._starts_chain(at + i):
                    return at + i
            at += n
        return self.size

    def records(self, start: int, end: int, aligned: bool = False) -> Iterator[tuple[int, int, int, bytes]]:
        """(place, time in us, length, bytes) of the whole records that start in a range; a record cut off by the end of the file is none."""
        if not self.known:
            return
        at = start if aligned else self.next_record(start)
        while at < end:
            head = self._bytes(at, RECORD)
            if len(head) < RECORD:
                return
            sec, part, kept, whole = struct.unpack(f"{self.order}IIII", head)
            raw = self._bytes(at + RECORD, kept)
            if len(raw) < kept:
                return
            yield at, sec * 1_000_000 + part // self.unit, whole, raw
            at += RECORD + kept

    def whole_until(self, start: int) -> int:
        """Where the last whole record ends; start is the end of one. Only the end of the file is read."""
        if not self.known:
            return self.size
        at = start if self.size - start <= 4 * self.longest else self.next_record(self.size - 3 * self.longest)
        while (got := self._header(at)) and at + RECORD + got[2] <= self.size:
            at += RECORD + got[2]
        return at


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    aligned: bool = False


def _splits(path: str, start: int, end: int, size: int, aligned: bool) -> list[Range]:
    return [Range(path, at, min(at + size, end), aligned and at == start) for at in range(start, end, size)]


def _batches(part: Range, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    capture = CaptureFile(part.path)
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        places, times, sizes, raw = zip(*held, strict=True)
        arrays = [pa.array([part.path] * len(held)), pa.array(places, pa.int64()), pa.array(times, pa.int64()), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["path", "frame_id", "ts_us", "length", "raw"])

    try:
        for record in capture.records(part.start, part.end, part.aligned):
            held.append(record)
            if len(held) == rows:
                yield batch()
                held = []
        if held:
            yield batch()
    finally:
        capture.close()


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        return [p for path, n in capture_files(self.path) if n > HEADER for p in _splits(path, 0, n, self.size, False)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are the bytes read of each file, always ends of records; a record that is still being written waits."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        for path, n in capture_files(self.path):
            before = self.seen.get(path, HEADER)
            if n > before:
                capture = CaptureFile(path)
                self.seen[path] = capture.whole_until(before)
                capture.close()
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        self.seen = {**new, **self.seen}
        return [p for path, n in sorted(new.items()) if n > old.get(path, HEADER) for p in _splits(path, old.get(path, HEADER), n, self.size, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition)

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    """Format `captures`: load(path) reads all capture files under it; option splitbytes (128 MB) bounds what one task reads.

    frame_id is the place of a record in its file. Works on every store that
    pyarrow reaches, and on streams.
    """

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def _args(self) -> tuple[str, int]:
        options = {k.lower(): v for k, v in self.options.items()}
        return options["path"], int(options.get("splitbytes", 128 << 20))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._args())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(*self._args())


def read_large_captures(spark: SparkSession, path: str, split_bytes: int = 128 << 20) -> DataFrame:
    """Records of all capture files under a path, each file read by as many tasks as it has splits."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("captures").option("splitbytes", split_bytes).load(path)


def stream_captures(spark: SparkSession, path: str, split_bytes: int = 128 << 20) -> DataFrame:
    """The records of capture files under a path as they grow and new ones come."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("captures").option("splitbytes", split_bytes).load(path)


def write_captures(packets: DataFrame, path: str, longest: int = 65_535, link_type: int = 105) -> DataFrame:
    """Write packets (ts_us, length, raw) as capture files, one a task, in the order of their rows; returns path, packets and bytes of each.

    A file gets its name when it is whole, so a task that is run again replaces
    its file. Packets without bytes or time are left out; longer ones than
    `longest` are cut, as a capture would.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _open(path)
        system.create_dir(inner, recursive=True)
        context = TaskContext.get()
        name = f"{inner}/part-{context.partitionId():05d}.pcap"
        draft = f"{inner}/_part-{context.partitionId():05d}-{context.taskAttemptId()}"
        n, size = 0, HEADER
        with system.open_output_stream(draft) as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, longest, link_type))
            for batch in batches:
                for ts, length, raw in zip(*(batch.column(c).to_pylist() for c in ("ts_us", "length", "raw")), strict=True):
                    if ts is None or raw is None:
                        continue
                    kept = raw[:longest]
                    out.write(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(kept), max(length or 0, len(raw))) + kept)
                    n, size = n + 1, size + RECORD + len(kept)
        if n:
            system.move(draft, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "packets": [n], "bytes": [size]})
        else:
            system.delete_file(draft)

    return packets.select("ts_us", "length", "raw").mapInArrow(write, "path string, packets long, bytes long")
