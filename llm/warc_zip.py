"""Operator 2, WARC: ZIP-packaged archives, read in place.

Writing: each task packs WARC records, every record its own gzip member, into a
``.warc.gz`` that is *stored* in a ZIP package beside an index of its records.
Reading: the end of a package names its central directory (ZIP64 where the
32-bit fields overflow), the directory locates the stored members, the index
locates the records, and each record is one range read. Nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, shuffle_partitions, utf8, with_found

# Record layouts of the ZIP format.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
_DOS_DATE = 0x21  # 1980-01-01: packages do not depend on when they are written


class ZipWriter:
    """Writes stored members to a stream, with ZIP64 records where they are needed.

    ``zip64`` writes them always, so that small packages exercise them too.
    """

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at = out, zip64, 0
        self.entries: list[tuple[bytes, int, int, int]] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, parts: list[bytes]) -> None:
        raw, crc, size = name.encode(), 0, sum(map(len, parts))
        for p in parts:
            crc = zlib.crc32(p, crc)
        wide = self.zip64 or size >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        shown = _FULL32 if wide else size
        self.entries.append((raw, crc, size, self.at))
        self._put(struct.pack("<IHHHHHIIIHH", _LOCAL, 45 if wide else 20, 0x800, 0, 0, _DOS_DATE, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        for p in parts:
            self._put(p)

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.entries:
            wide = self.zip64 or size >= _FULL32 or offset >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            shown, where = (_FULL32, _FULL32) if wide else (size, offset)
            self._put(
                struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, _DOS_DATE, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, where) + raw + extra
            )
        length, n = self.at - start, len(self.entries)
        if self.zip64 or start >= _FULL32 or n >= _FULL16:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<IIQI", _LOCATOR64, 0, end64, 1))
            n, length, start = _FULL16, _FULL32, _FULL32
        self._put(struct.pack("<IHHHHIIH", _END, 0, 0, n, n, length, start, 0))


def central_directory(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int, int]]:
    """``{name: (data offset, bytes, crc32)}`` of a package's stored members.

    ``read(offset, length)`` is the only access. Raises ValueError for anything
    that is not a package or whose members are compressed.
    """
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", _END))
    if at < 0 or len(tail) - at < 22:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    if n == _FULL16 or length == _FULL32 or start == _FULL32:
        kind, _, end64, _ = struct.unpack("<IIQI", read(tail_at + at - 20, 20))
        if kind != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        kind, _, _, _, _, _, _, n, length, start = struct.unpack("<IQHHIIQQQQ", read(end64, 56))
        if kind != _END64:
            raise ValueError("no ZIP64 end of central directory")
    directory, found, at = read(start, length), {}, 0
    for _ in range(n):
        kind, _, _, _, method, _, _, crc, packed, full, n_name, n_extra, n_comment, _, _, _, where = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if kind != _CENTRAL:
            raise ValueError("broken central directory")
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_comment
        while len(extra) >= 4:
            tag, size_of = struct.unpack_from("<HH", extra)
            if tag == 1:  # holds, in this order, only the fields that overflowed
                wide = iter(struct.unpack_from(f"<{size_of // 8}Q", extra, 4))
                full = next(wide) if full == _FULL32 else full
                packed = next(wide) if packed == _FULL32 else packed
                where = next(wide) if where == _FULL32 else where
            extra = extra[4 + size_of :]
        if method:
            raise ValueError(f"{name} is compressed; records in it cannot be read in place")
        head = read(where, 30)
        n_name, n_extra = struct.unpack_from("<HH", head, 26)  # the local header has its own extra field
        found[name] = (where + 30 + n_name + n_extra, packed, crc)
    return found


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit names its original and has no block."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').splitlines()[0] if url else ''}",
        "WARC-Date: 1980-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode()) + packer.compress(block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """``(headers, block)`` of one gzip member; ValueError if it is not a whole record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("cut record")
    return headers, rest[:n]


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI or plain path, and the path in it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_packages(records: DataFrame, folder: str, package_bytes: int = 16 << 20, zip64: bool = True) -> DataFrame:
    """Write ``records(page_id, url, payload, refers_to)``; the packages' ``(path, bytes, records)``.

    ``folder`` is shared. A package's name has its content's hash, and it is
    put in place whole, so a task that runs twice writes the same files. The
    list is a written table; only packages on it count.
    """

    def run(batches):
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        held: list[bytes] = []
        index: list[str] = []
        size = 0

        def put() -> pa.RecordBatch:
            buffer = io.BytesIO()
            package = ZipWriter(buffer, zip64)
            package.add("archive/data.warc.gz", held)
            package.add("indexes/index.cdxj", ["".join(index).encode()])
            package.close()
            data = buffer.getvalue()
            name = f"{top}/{hashlib.sha256(data).hexdigest()}.wacz"
            with store.open_output_stream(part := f"{name}.{uuid.uuid4().hex}") as out:
                out.write(data)
            store.move(part, name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)]), pa.array([len(held)])], names=["path", "bytes", "records"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                member = warc_record(page_id, url, payload, refers_to)
                index.append(json.dumps({"offset": size, "length": len(member)}) + "\n")
                held.append(member)
                size += len(member)
                if size >= package_bytes:
                    yield put()
                    held, index, size = [], [], 0
        if held:
            yield put()

    rows = records.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("payload").cast("binary"), F.col("refers_to").cast("long"))
    return materialize(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-packages")


def _records(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    members = central_directory(read, size)
    data_at, _, _ = members["archive/data.warc.gz"]
    at, length, crc = members["indexes/index.cdxj"]
    index = read(at, length)
    if zlib.crc32(index) != crc:
        raise ValueError("index does not match its checksum")
    for line in index.splitlines():
        entry = json.loads(line)
        yield parse_record(read(data_at + entry["offset"], entry["length"]))


def read_packages(packages: DataFrame, folder: str) -> DataFrame:
    """``(page_id, record_type, refers_to, payload_bytes, payload_digest, payload)`` of every record.

    Only the end, directory, index and records of a package are read. A
    response's digest is checked against its block.
    """

    def run(batches):
        store, _ = _store(folder)
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as f:
                    out, held = [], 0
                    for headers, block in _records(lambda at, n: f.read_at(n, at), size):
                        kind = headers["WARC-Type"]
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and _digest(block) != digest:
                            raise ValueError(f"{path}: a record does not match its digest")
                        refers = headers.get("WARC-Refers-To")
                        out.append((_page(headers["WARC-Record-ID"]), kind, _page(refers) if refers else None, int(headers["X-Payload-Length"]), digest, block))
                        held += len(block)
                        if held > 8 << 20:
                            yield _batch(out)
                            out, held = [], 0
                    if out:
                        yield _batch(out)

    return packages.select("path", "bytes").mapInArrow(
        run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def with_originals(pages: DataFrame, id_col: str, text_col: str, revisit_from: int) -> DataFrame:
    """Each page's id and payload digest with ``refers_to``: null for a response, else the id of its original.

    Of pages with equal payloads of at least ``revisit_from`` bytes the smallest
    id is the response. Equal means equal SHA-256 and length. Copies are
    combined before the shuffle; the join back is on two written tables, so
    a hot payload's rows can be split.
    """
    keyed = materialize(
        pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(utf8(text_col), 256).alias("sha"), F.octet_length(utf8(text_col)).alias("n")),
        "warc-keys",
    )
    firsts = materialize(keyed.filter(F.col("n") >= revisit_from).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")), "warc-firsts")
    return with_found(keyed, firsts, ["sha", "n"], "rows").select(
        "page_id", "sha", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to")
    )


def archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", revisit_from: int = 0, package_bytes: int = 16 << 20
) -> tuple[DataFrame, str]:
    """Write all pages as packages; ``(their list, their folder)``.

    Defined results: a null payload is empty; null URLs are empty; rows with
    the same id and payload are responses each, as none is smaller; a page with
    a null id is written as a response and read back with a null id; an empty table writes no package; other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    originals = with_originals(pages, id_col, text_col, revisit_from)
    revisits = originals.filter("refers_to IS NOT NULL").distinct().select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), utf8(text_col).alias("payload"))
    same = (F.col("page_id") == F.col("_id")) & (F.sha2("payload", 256) == F.col("_sha"))
    records = rows.join(revisits, same, "left").select("page_id", "url", "payload", "refers_to")
    return write_packages(records, folder, package_bytes), folder


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` and read every record back."""
    packages, folder = archive(pages, **how)
    spark = pages.sparkSession
    return read_packages(packages.repartition(shuffle_partitions(spark)), folder)
