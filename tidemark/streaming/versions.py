"""Versions of the cluster index: a batch takes the newest, and makes a new one when that is too old."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class IndexVersions:
    """Written versions under ``folder``, one for each time it was made; a version never changes.

    Versions are read by their number from the folder's own listing, so a new
    process goes on with what the last one left. Two that refresh at the same
    second write the same version, the later one over the earlier.
    """

    def __init__(self, spark: SparkSession, folder: str, refresh: timedelta = timedelta(seconds=300)):
        self.spark, self.folder, self.refresh = spark, folder, refresh

    def newest(self) -> datetime | None:
        """When the newest version was made."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version=*/_SUCCESS")  # a write that broke off has none
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        made = [int(s.getPath().getParent().getName().split("=")[1]) for s in found or ()]
        return datetime.fromtimestamp(max(made)) if made else None

    def stale(self, now: datetime) -> bool:
        """Never made, or made more than ``refresh`` ago."""
        made = self.newest()
        return made is None or now - made > self.refresh

    def refreshed(self, now: datetime, build: Callable[[], DataFrame]) -> datetime:
        """When the version to use now was made; it is made by ``build`` first if the newest is stale. A version may have no rows."""
        if self.stale(now):
            build().write.mode("overwrite").parquet(self._path(now))
        return self.newest()

    def current(self, now: datetime, build: Callable[[], DataFrame]) -> DataFrame:
        """The newest version, made by ``build`` first if that is stale."""
        return self.read(self.refreshed(now, build))

    def read(self, made: datetime) -> DataFrame:
        return self.spark.read.parquet(self._path(made)).withColumn("index_version", F.lit(int(made.timestamp())))

    def _path(self, made: datetime) -> str:
        return f"{self.folder}/version={int(made.timestamp())}"

