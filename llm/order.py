"""Places of rows in a global order, from totals of bounded runs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: A run has at most 2^RUN_BITS rows: that much one window task sorts, and the
#: driver sees one row of totals per run.
RUN_BITS = 16


def place_rows(df: DataFrame, keys: list[str], tag: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``place``, each row's number from 0 in the order of ``keys``.

    With ``weight`` also ``before``, the weights of all earlier rows, and
    ``total``. A range shuffle orders the rows; equal keys are ordered as they
    lie, once and for all, since the ordered rows are written as a table.
    """
    spark = df.sparkSession
    ordered = materialize(
        df.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_run", F.shiftright("_pos", RUN_BITS)),
        tag,
    )
    weighed = F.col(weight) if weight else F.lit(0).cast("long")
    # run numbers rise with the order, so their running sums are the prefix sums
    totals = ordered.groupBy("_run").agg(F.sum(weighed).alias("w"), F.count("*").alias("n")).collect()
    offsets, w, n = [], 0, 0
    for t in sorted(totals, key=lambda t: t["_run"]):
        offsets.append((t["_run"], w, n))
        w += t["w"]
        n += t["n"]
    runs = spark.createDataFrame(offsets, "_run long, _w long, _n long")
    own = Window.partitionBy("_run").orderBy("_pos")
    placed = ordered.join(F.broadcast(runs), "_run").withColumn("place", F.col("_n") + F.row_number().over(own) - 1)
    if weight:
        placed = placed.withColumn("before", F.col("_w") + F.sum(weight).over(own) - F.col(weight)).withColumn("total", F.lit(w).cast("long"))
    return placed.drop("_pos", "_run", "_w", "_n")
