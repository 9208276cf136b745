"""Connectors: landed payloads as a stream of records, with offsets that can be replayed.

A connector says how one landed payload is cut into entries and how an entry
becomes a record. Fetchers land payloads in a folder and list them in a
manifest, ``manifest.jsonl``: a line for each file with its name, the number of
its entries and the time it was fetched. Offsets count entries along the
manifest, so a batch has an exact bound, and a batch that runs again reads the
same entries. A trigger takes one batch, or as many as it is told to where a
backlog waits, as a trigger costs more in bookkeeping than a batch in work; rows
say which batch they are of.
"""

from __future__ import annotations

import abc
import bisect
import json
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MANIFEST = "manifest.jsonl"
#: Records of a batch at most.
BATCH = 250
#: Batches of a task at most.
TASK = 20


class Connector(abc.ABC):
    """One kind of source; ``name`` is its records' source."""

    name: str

    @abc.abstractmethod
    def entries(self, payload: bytes) -> list[Any]:
        """The entries of a payload, in its order; raises ValueError for one that cannot be read."""

    @abc.abstractmethod
    def convert(self, entry: Any) -> dict[str, Any]:
        """The fields of an entry's record, ``source_id`` among them; raises ValueError for one that is no record."""

    def record(self, entry: Any, collected_at: int) -> dict[str, Any]:
        """The record: the entry's fields under this source's name, without nulls."""
        made = {"source": self.name, "collected_at": collected_at, **self.convert(entry)}
        if not made.get("source_id"):
            raise ValueError("no source_id")
        return {k: v for k, v in made.items() if v is not None}


class RssConnector(Connector):
    name = "rss"

    def entries(self, payload):
        try:
            root = ElementTree.fromstring(payload)
        except ElementTree.ParseError as bad:
            raise ValueError(f"no XML: {bad}") from None
        return [{c.tag: (c.text or "").strip() for c in item} for item in root.iter("item")]

    def convert(self, entry):
        title, summary, link = (entry.get(k, "") for k in ("title", "description", "link"))
        if not link or not title:
            raise ValueError("no link or title")
        return {"source_id": link, "url": link, "title": title, "text": f"{title}. {summary}" if summary else title, "published_at": entry.get("pubDate") or None}


class ArticleListConnector(Connector):
    name = "gdelt"

    def entries(self, payload):
        try:
            return list(json.loads(payload)["articles"])
        except (ValueError, KeyError, TypeError) as bad:
            raise ValueError(f"no article list: {bad!r}") from None

    def convert(self, entry):
        if not isinstance(entry, dict) or not entry.get("url"):
            raise ValueError("no url")
        image = entry.get("socialimage")
        return {"source_id": entry["url"], "url": entry["url"], "title": entry.get("title"), "published_at": entry.get("seendate"), "media_urls": [image] if image else []}


#: Connectors by the name that the option ``connector`` takes.
CONNECTORS: dict[str, type[Connector]] = {c.name: c for c in (RssConnector, ArticleListConnector)}


@dataclass
class Slice(InputPartition):
    """Parts of landed files: ``(file, collected_at, first, end, at)``, the last the offset of a file's first entry."""

    parts: list[tuple[str, int, int, int, int]]


class _Manifest:
    """The lines of a manifest, which only grows: what was read is not read again."""

    def __init__(self, folder: str):
        self.store, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.path, self.read = f"{path}/{MANIFEST}", 0
        self.files: list[dict[str, Any]] = []
        self.starts, self.entries = [], 0  # the offset of each file's first entry, and of the next file's

    def refresh(self) -> None:
        found = self.store.get_file_info(self.path)
        if found.type == fs.FileType.NotFound or found.size <= self.read:
            return
        with self.store.open_input_file(self.path) as f:
            f.seek(self.read)
            fresh = f.read()
        whole = fresh[: fresh.rfind(b"\n") + 1]  # the last line may not be whole yet
        self.read += len(whole)
        for line in filter(None, whole.decode().split("\n")):
            self.files.append(json.loads(line))
            self.starts.append(self.entries)
            self.entries += self.files[-1]["entries"]

    def between(self, start: int, end: int) -> Iterator[tuple[str, int, int, int, int]]:
        for k in range(max(0, bisect.bisect_right(self.starts, start) - 1), bisect.bisect_left(self.starts, end)):
            f, at = self.files[k], self.starts[k]
            first, stop = max(start, at), min(end, at + f["entries"])
            if first < stop:
                yield f["file"], f["fetched_at"], first - at, stop - at, at


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.size, self.progress = options["path"], int(options.get("records", BATCH)), options.get("progress")
        self.most = self.size * int(options.get("batches", 1))
        self.connector = CONNECTORS[options["connector"]]()
        self.manifest = None  # made where it is asked, as tasks get copies of the reader
        self.last = self._committed()

    def _listed(self) -> _Manifest:
        self.manifest = self.manifest or _Manifest(self.folder)
        self.manifest.refresh()
        return self.manifest

    def __getstate__(self):
        return self.__dict__ | {"manifest": None}

    def _committed(self) -> int:
        """Where a process before this one came to; offsets in the checkpoint decide, this only bounds the first batch."""
        if not self.progress:
            return 0
        store, path = fs.FileSystem.from_uri(self.progress if "://" in self.progress else f"file://{self.progress}")
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return 0
        with store.open_input_stream(path) as f:
            return json.loads(f.read())["entries"]

    def initialOffset(self):
        return {"entries": 0}

    def latestOffset(self):
        return {"entries": min(self._listed().entries, self.last + self.most)}

    def partitions(self, start, end):
        self.last = max(self.last, end["entries"])
        listed, step = self._listed(), self.size * TASK
        cuts = [*range(start["entries"], end["entries"], step), end["entries"]]
        return [Slice(list(listed.between(lo, hi))) for lo, hi in zip(cuts, cuts[1:])]

    def commit(self, end):
        self.last = max(self.last, end["entries"])
        if self.progress:
            store, path = fs.FileSystem.from_uri(self.progress if "://" in self.progress else f"file://{self.progress}")
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(end).encode())
            store.move(f"{path}.new", path)

    def read(self, partition) -> Iterator[tuple]:
        store, path = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        for file, collected_at, first, end, at in partition.parts:
            with store.open_input_stream(f"{path}/{file}") as f:
                payload = f.read()
            try:
                entries = self.connector.entries(payload)
            except ValueError as bad:
                yield (self.connector.name, payload.decode(errors="replace"), f"{file}: {bad}", (at + first) // self.size)
                continue
            for k, entry in enumerate(entries[first:end], at + first):
                try:
                    made, why = self.connector.record(entry, collected_at), None
                except ValueError as bad:
                    made, why = entry, str(bad)
                yield (self.connector.name, json.dumps(made, ensure_ascii=False), why, k // self.size)


class LandedSource(DataSource):
    """``readStream.format("landed")``: options ``connector``, ``path``, ``records`` (of a batch), ``batches`` (of a trigger), ``progress`` (a file)."""

    @classmethod
    def name(cls):
        return "landed"

    def schema(self):
        return "connector string, value string, error string, batch long"

    def streamReader(self, schema):
        return _Reader(self.options)


def stream(spark: SparkSession, connector: str, path: str, progress: str, records: int = BATCH, batches: int = 1) -> DataFrame:
    """``(connector, value, error, batch)``: a record as JSON, or what could not be read and why, for the dead letters;
    and its batch: each ``records`` entries along the manifest, of which a trigger takes up to ``batches``."""
    if connector not in CONNECTORS:
        raise ValueError(f"no connector {connector}; there are {', '.join(sorted(CONNECTORS))}")
    spark.dataSource.register(LandedSource)
    return spark.readStream.format("landed").options(connector=connector, path=path, progress=progress, records=records, batches=batches).load()


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records, as ``value`` lines for ``ingest.parse_records``, and dead letters."""
    return rows.filter("error IS NULL").select("value"), rows.filter(F.col("error").isNotNull())
