"""The data source `captures`: byte ranges of capture files as Arrow batches of frames, in batch and as a stream.

A capture is whole records of 6144 bytes, and perhaps a cut-off one at its end. Files are
planned as ranges of whole records, whatever their size, so a long capture is read by many
tasks; a task holds one batch at a time. A record's number is its offset divided by its
size. Batches are cut from the bytes read, without a look at single frames.

    spark.dataSource.register(Captures)
    spark.read.format("captures").load("s3://bucket/dab/")
    spark.readStream.format("captures").load("/captures")

Columns: stream_id (the file), frame_no, ts (when the file was last written, as the read
was planned), raw. Options: pattern (of file names, all), splitBytes (16 MB), tail
(true: a cut-off record is a row too, with the bytes it has; streams wait for the rest),
mode (frames; or profile: a row a file, with n_bytes, its first bytes as head, and sha256).

A stream keeps the number of bytes it has read of each file, so files that grow are
followed, and each whole record is delivered once. A file that shrinks is taken for a new
one and read from its start.

Paths are opened by pyarrow: local paths and the schemes it has (s3, gs, hdfs, abfs).
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FRAME_BYTES = 6144
#: Bytes of a range, and of one Arrow batch.
SPLIT_BYTES, BATCH_BYTES = 16 << 20, 2 << 20
SCHEMA = "stream_id string, frame_no long, ts timestamp, raw binary"
PROFILE = "stream_id string, n_bytes long, ts timestamp, head binary, sha256 string"
#: Schemes that pyarrow opens.
SCHEMES = {"", "file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss"}


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path on it, and what to put before such a path to name the file."""
    scheme = urlsplit(path).scheme if "://" in path or path.startswith("file:") else ""
    if scheme in ("", "file"):
        local = path.removeprefix("file:")
        return pafs.LocalFileSystem(), "/" + local.lstrip("/") if local.startswith("/") else local, "file:"
    system, inner = pafs.FileSystem.from_uri(quote(path, safe=":/@?=&%"))
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else f"{scheme}://"


def listed(path: str, pattern: str = "*") -> list[tuple[str, int, float]]:
    """(name, bytes, time of the last write) of the files at or below path that hold something, by name. Names that begin with a dot or underscore are left out."""
    system, inner, before = opened(path)
    one = system.get_file_info(inner)
    if one.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [one] if one.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, recursive=True))
    files = [f for f in found if f.type == pafs.FileType.File and f.size and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._"]
    return sorted((before + f.path, f.size, (f.mtime_ns or 0) / 1e9) for f in files)


@dataclass
class Range(InputPartition):
    """Bytes start to end of a file; start is a multiple of the record size."""

    path: str
    start: int
    end: int
    written: float


def ranges(path: str, start: int, end: int, written: float, split: int, tail: bool = False) -> Iterator[Range]:
    """Whole records from start to end, about `split` bytes each; with a cut-off record in the last, if tail."""
    step = max(1, split // FRAME_BYTES) * FRAME_BYTES
    end = end if tail else end - end % FRAME_BYTES
    for at in range(start, end, step):
        yield Range(path, at, min(at + step, end), written)


def batch(path: str, first: int, data: bytes | pa.Buffer, written: float) -> pa.RecordBatch:
    """A row for each record of data; the last may be a cut-off one."""
    size = len(data)
    n = -(-size // FRAME_BYTES)
    edges = pa.array([min(i * FRAME_BYTES, size) for i in range(n + 1)], pa.int32())
    raw = pa.Array.from_buffers(pa.binary(), n, [None, edges.buffers()[1], pa.py_buffer(data)])
    at = pa.scalar(dt.datetime.fromtimestamp(written, dt.timezone.utc), pa.timestamp("us", "UTC"))
    return pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(range(first, first + n), pa.int64()), pa.repeat(at, n), raw], ["stream_id", "frame_no", "ts", "raw"])


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    system, inner, _ = opened(part.path)
    step = max(1, BATCH_BYTES // FRAME_BYTES) * FRAME_BYTES
    with system.open_input_file(inner) as f:
        f.seek(part.start)
        at = part.start
        while at < part.end:
            data = f.read(min(step, part.end - at))
            if not data:
                raise OSError(f"{part.path} ends at {at}, before {part.end}")
            if len(data) % FRAME_BYTES and at + len(data) < part.end:  # a short read in the middle
                data += f.read(min(FRAME_BYTES - len(data) % FRAME_BYTES, part.end - at - len(data)))
            yield batch(part.path, at // FRAME_BYTES, data, part.written)
            at += len(data)


class Captures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return PROFILE if self.options.get("mode") == "profile" else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (ProfileReader if self.options.get("mode") == "profile" else CaptureReader)(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return CaptureStream(self.options)


class Options:
    def __init__(self, options: dict):
        # Several paths come as a JSON list.
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.pattern = options.get("pattern", "*")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.tail = options.get("tail", "false").lower() == "true"

    def files(self) -> list[tuple[str, int, float]]:
        return sorted({f[0]: f for p in self.paths for f in listed(p, self.pattern)}.values())


class CaptureReader(Options, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for path, size, written in self.files() for r in ranges(path, 0, size, written, self.split, self.tail)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return iter(())
        return read_range(partition)


@dataclass
class Files(InputPartition):
    """Files that one task reads whole, one after the other: name, bytes, time of the last write."""

    files: list[tuple[str, int, float]]


class ProfileReader(Options, DataSourceReader):
    def partitions(self) -> list[Files]:
        out, held = [Files([])], 0
        for f in self.files():
            if out[-1].files and held + f[1] > self.split:
                out.append(Files([]))
                held = 0
            out[-1].files.append(f)
            held += f[1]
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path, _, written in partition.files if partition else []:
            system, inner, _ = opened(path)
            h, n, head = hashlib.sha256(), 0, b""
            with system.open_input_stream(inner, compression=None) as f:
                while data := f.read(BATCH_BYTES):
                    head = head or data[:16]
                    n += len(data)
                    h.update(data)
            at = pa.array([dt.datetime.fromtimestamp(written, dt.timezone.utc)], pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), at, pa.array([head], pa.binary()), pa.array([h.hexdigest()])], ["stream_id", "n_bytes", "ts", "head", "sha256"])


class CaptureStream(Options, DataSourceStreamReader):
    """Offsets: bytes of whole records by file."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: size - size % FRAME_BYTES for path, size, _ in self.files() if size >= FRAME_BYTES}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        written = {path: at for path, _, at in self.files()}
        out = []
        for path, to in sorted(end.items()):
            begin = start.get(path, 0)
            out += ranges(path, begin if begin <= to else 0, to, written.get(path, 0.0), self.split)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


def captures(spark: SparkSession) -> str:
    """Registers the source in the session; its name."""
    spark.dataSource.register(Captures)
    return Captures.name()


def readable(path: str) -> bool:
    """Whether pyarrow has the path's scheme; others are left to Hadoop's readers."""
    return (urlsplit(path).scheme if "://" in path else "") in SCHEMES
