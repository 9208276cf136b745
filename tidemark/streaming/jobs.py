"""Streams: landed JSON lines to stored records, and batches of records to clusters.

Progress is the checkpoint's, so a restarted stream goes on where it stopped;
both sinks are idempotent, so a batch that runs twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import times
from ..operators import ingest


def landed_lines(spark: SparkSession, folder: str, files_per_batch: int = 250) -> DataFrame:
    """JSON lines as they land in ``folder``; a batch takes so many files at most."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)


#: The store is dealt by key to so many folders; a batch reads those its keys are in.
BUCKETS = 256


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*ingest.KEY), F.lit(BUCKETS)).cast("int")


def store_batch(batch: DataFrame, batch_id: int, table: str, dead_letters: str, counts: str) -> None:
    """Store a batch's new records under ``table``, and count what became of all.

    Only INSERTED records are stored, so a record that comes again with a place
    or a time is new. Keys are stored apart in buckets, of which only those of
    the batch's keys are read. A batch overwrites its own folders, and other
    batches' folders are what is already stored, so running it again gives the
    same files.
    """
    spark = batch.sparkSession
    records, dead = ingest.parse_records(batch)
    dead.write.mode("overwrite").text(f"{dead_letters}/batch={batch_id}")
    arrived = records.withColumn("arrival", F.monotonically_increasing_id()).persist()
    try:
        buckets = [r[0] for r in arrived.select(_bucket()).distinct().collect()]
        stored = _stored_keys(spark, f"{table}-keys", batch_id, buckets)
        judged = ingest.classified(arrived, stored).withColumn("published", times.parse_iso(F.col("published_at"))).persist()
        fresh = judged.filter("disposition = 'INSERTED'").drop("arrival", "disposition")
        # keys last: a batch that broke off before them is done again whole
        judged.groupBy("disposition").count().write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")
        fresh.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        keys = fresh.select(*ingest.KEY, _bucket().alias("bucket"), F.lit(batch_id).cast("long").alias("of_batch"))
        keys.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}-keys/batch={batch_id}")
        judged.unpersist()
    finally:
        arrived.unpersist()


def _stored_keys(spark: SparkSession, folder: str, batch_id: int, buckets: list[int]) -> DataFrame:
    schema = "source string, source_id string, of_batch long, batch int, bucket int"
    try:
        found = spark.read.schema(schema).parquet(folder)
    except AnalysisException as absent:  # the first batch: nothing is stored yet
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        found = spark.createDataFrame([], schema)
    return found.filter(F.col("bucket").isin(buckets) & (F.col("of_batch") < batch_id)).select(*ingest.KEY)


def ingest_stream(spark: SparkSession, landing: str, home: str, every: str | None = "5 seconds", files_per_batch: int = 250) -> StreamingQuery:
    """Run ``store_batch`` over what lands; ``every=None`` takes what is there and ends."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, f"{home}/items", f"{home}/dead", f"{home}/counts")

    writer = landed_lines(spark, landing, files_per_batch).writeStream.foreachBatch(sink).option("checkpointLocation", f"{home}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def cluster_stream(
    spark: SparkSession, home: str, work: Callable[[DataFrame, int], None], every: str | None = "5 seconds"
) -> StreamingQuery:
    """Run ``work`` on the records that each batch of ``ingest_stream`` inserted.

    The stream follows the landed files, as the ingest does, and a batch takes
    its keys' records from the store; so files that a rerun replaces are not
    seen twice. ``work`` gets records and a batch number, and must be the same
    when it is run again; ``clustering.cycle`` is.
    """
    schema = "source string, source_id string, of_batch long"
    keys = spark.readStream.schema(f"{schema}, batch int, bucket int").parquet(f"{home}/items-keys")

    def sink(batch: DataFrame, batch_id: int) -> None:
        # records lie in the folder of the batch that inserted them, and keys name it
        of = [r[0] for r in batch.select("of_batch").distinct().collect()]
        items = spark.read.parquet(f"{home}/items").filter(F.col("batch").isin(of)).drop("batch")
        work(items.join(batch.select(*ingest.KEY).distinct(), ingest.KEY, "left_semi").dropDuplicates(ingest.KEY), batch_id)

    writer = keys.writeStream.foreachBatch(sink).option("checkpointLocation", f"{home}/cluster-checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def vessel_counts(messages: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Extension: messages and vessels per event-time window of a stream, with a watermark."""
    return (
        messages.withWatermark("ts", late)
        .groupBy(F.window("ts", window))
        .agg(F.count("*").alias("messages"), F.approx_count_distinct("mmsi").alias("vessels"))
    )
