"""Operator 6, sharding: contiguous shards of near-equal bytes.

Rows are put in a global order by a range shuffle of narrow rows. Totals per
partition give every partition the bytes before it; a row's shard is where its
middle byte falls among equal targets, so each cut lies at the row edge nearest its target. All on DataFrame functions: the only
thing the driver sees is one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, utf8
from .order import place_rows


def byte_shards(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_overhead: int = 16,
    together: float = 1 / 200,
) -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``shard``, ``slot``.

    The order is (hash of the text, id), so equal texts are neighbours. A cut
    that falls into a group of equal texts moves to the group's nearer edge if
    the group is no larger than the largest row or the share ``together`` of a
    shard; only larger groups straddle cuts. A shard is off its target by half
    such a group at most on either side. Defined results: a null text has
    no bytes beside the overhead; a text larger than a shard's target may leave
    a neighbouring shard empty; repeated rows get
    slots of their own; null ids come first within their text; an empty table
    gives an empty result.
    """
    body = utf8(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(body) + row_overhead).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
    )

    def shard_of(before, size):
        middle = before.cast("decimal(38,0)") * 2 + size
        share = F.floor(middle * shards / F.greatest(F.col("total") * 2, F.lit(1)))
        return F.least(share, F.lit(shards - 1)).cast("int")

    placed = place_rows(rows, ["h", "doc_id"], "shard-order", weight="size").withColumn("own", shard_of(F.col("before"), F.col("size")))
    placed = materialize(placed, "shard-places")
    largest = placed.agg(F.max("size")).first()[0] or 0
    groups = placed.groupBy("h").agg(
        F.min("own").alias("low"), F.max("own").alias("high"), F.min("before").alias("before"), F.sum("size").alias("size"), F.first("total").alias("total")
    )
    # of groups that are cut there are fewer than shards
    cut = groups.filter((F.col("low") < F.col("high")) & (F.col("size") <= F.greatest(F.lit(largest), F.col("total") * together / shards)))
    cut = cut.select(F.col("h").alias("of"), shard_of(F.col("before"), F.col("size")).alias("whole"))
    placed = placed.join(F.broadcast(cut), F.col("h") == F.col("of"), "left").withColumn("shard", F.coalesce("whole", "own"))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )
