"""Leader clustering of a batch, equal to the one-by-one rule but run in rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: computed once, without lineage, in the shared folder the cluster names."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or f"file://{tempfile.gettempdir()}/checkpoints")
    return df.checkpoint()


def leaders(items: DataFrame, accepts: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``(id, leader)``: which items found a cluster when all are taken one by one.

    ``accepts(earlier, later)`` holds the pairs in which ``earlier``, were it a
    leader, would take ``later``; ``taken(id)`` the items that existing clusters
    take. An item leads if none of its earlier acceptors leads. Each round
    settles items whose answer no longer depends on an open one, so rounds grow
    with the longest chain of dependencies, not with the rows; lineage is cut
    by checkpoints. The earliest open item settles in every round, so it ends.
    """
    spark = items.sparkSession
    open_items = items.select("id")
    settled = spark.createDataFrame([], "id bigint, leader boolean")
    if taken is not None:
        settled = taken.select("id", F.lit(False).alias("leader")).distinct()
        open_items = open_items.join(taken.select("id"), "id", "left_anti")
    edges = cut(accepts.select("earlier", "later").distinct())
    while True:
        state = settled.select(F.col("id").alias("earlier"), "leader")
        seen = edges.join(state, "earlier", "left").groupBy(F.col("later").alias("id")).agg(
            F.max(F.coalesce("leader", F.lit(False))).alias("led"), F.max(F.col("leader").isNull()).alias("waits")
        )
        answer = F.when(F.coalesce("led", F.lit(False)), F.lit(False)).when(~F.coalesce("waits", F.lit(False)), F.lit(True))
        now = cut(open_items.join(seen, "id", "left").select("id", answer.alias("leader")))
        settled = cut(settled.unionByName(now.filter("leader IS NOT NULL")))
        open_items = now.filter("leader IS NULL").select("id")
        if open_items.isEmpty():
            return settled
