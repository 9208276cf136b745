"""Where payloads land: folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder of this application under ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"  # one machine: the driver's disk is everyone's
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def write_files(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows(name, content)`` as a file each under ``path``, from the tasks; ``(name, bytes)`` of what was written.

    A file appears whole or not at all, and one that is written again is the same.
    """

    def run(batches):
        store, folder_ = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(folder_, recursive=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist()):
                data = (content or "").encode()
                part = f"{folder_}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, f"{folder_}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return rows.select("name", "content").mapInArrow(run, "name string, bytes long")
