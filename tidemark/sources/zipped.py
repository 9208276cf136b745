"""Lines of a member of ZIP archives, read in byte ranges without unpacking.

A stored member lies in its archive as it is, so it is cut into ranges that
tasks read apart: a range begins behind the first line end at or after its
start and reads on to the end of its last line. A deflated member has no places
to begin at and is one task.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range; lines of an Arrow batch.
RANGE = 64 << 20
LINES = 50_000


@dataclass
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a member that begins at ``first`` and ends at ``last`` in its archive; ``first`` < 0: the whole member, deflated."""

    archive: str
    member: str
    first: int
    last: int
    start: int
    end: int


def _archives(uri: str) -> list[str]:
    store, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
    scheme = uri.split("://")[0] if "://" in uri else "file"
    host = uri.split("://")[1].removesuffix(path) if "://" in uri else ""
    return sorted(f"{scheme}://{host}{i.path}" for i in found if i.type == fs.FileType.File and i.path.endswith(".zip"))


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _ranges(archive: str, member: str, size: int) -> Iterator[Range]:
    with _open(archive) as f, zipfile.ZipFile(f) as z:
        try:
            info = z.getinfo(member)
        except KeyError:
            raise FileNotFoundError(f"{member} is not in {archive}") from None
        if info.compress_type != zipfile.ZIP_STORED:
            yield Range(archive, member, -1, -1, 0, 0)
            return
        f.seek(info.header_offset)
        names, extra = struct.unpack("<HH", f.read(30)[26:])
        first = info.header_offset + 30 + names + extra
        for at in range(0, info.file_size, size):
            yield Range(archive, member, first, first + info.file_size, first + at, first + min(at + size, info.file_size))


def _lines(part: Range) -> Iterator[bytes]:
    if part.first < 0:
        with _open(part.archive) as f, zipfile.ZipFile(f) as z, z.open(part.member) as m:
            yield from m
        return
    with _open(part.archive) as f:
        # from the byte before: a line that begins just at the start is this range's own
        at = max(part.first, part.start - 1)
        f.seek(at)
        buffered = io.BufferedReader(f, 1 << 20)
        if part.start > part.first:
            at += len(buffered.readline())
        while at < part.end:
            line = buffered.readline(part.last - at)
            at += len(line)
            yield line
        buffered.detach()


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.member, self.size = options["path"], options["member"], int(options.get("range", RANGE))

    def partitions(self):
        return [r for a in _archives(self.path) for r in _ranges(a, self.member, self.size)] or [Range("", self.member, 0, 0, 0, 0)]

    def read(self, partition):
        def batch(lines):
            return pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], names=["value"])

        held: list[bytes] = []
        for line in _lines(partition) if partition.archive else ():
            held.append(line.rstrip(b"\r\n"))
            if len(held) == LINES:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


class ZipLines(DataSource):
    """``spark.read.format("zip_lines")``: options ``path`` (an archive or a folder of them), ``member``, ``range``."""

    @classmethod
    def name(cls):
        return "zip_lines"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return _Reader(self.options)


def member_lines(spark: SparkSession, path: str, member: str, size: int = RANGE) -> DataFrame:
    """``value``: the lines of ``member`` in every archive under ``path``, without their ends."""
    spark.dataSource.register(ZipLines)
    return spark.read.format("zip_lines").options(path=path, member=member, range=size).load()


def write_members(lines: DataFrame, path: str, member: str, compression: int = zipfile.ZIP_STORED) -> None:
    """Write ``lines(value)`` as ``member`` of an archive for each partition, under ``path``."""

    def run(batches):
        import uuid

        store, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(folder, recursive=True)
        name = f"{folder}/part-{uuid.uuid4().hex}.zip"
        with store.open_output_stream(f"{name}.tmp") as out, zipfile.ZipFile(out, "w", compression) as z, z.open(member, "w") as m:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    m.write((line or "").encode() + b"\n")
        store.move(f"{name}.tmp", name)  # a task that broke off leaves no archive
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["archive"])

    lines.select("value").mapInArrow(run, "archive string").collect()
