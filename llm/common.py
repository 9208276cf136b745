"""Small helpers that the operators share: tables, scratch tables, splits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; only Spark opens the path, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``.

    Driver and executors share it. Scratch tables there live as long as the
    frames that read them; ``drop_scratch`` removes them all.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"  # one machine: the driver's disk is everyone's
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage and survives lost executors; what comes back is a plain
    scan, so a join on it has exchanges on both sides that AQE can split.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the contracts' split rule."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def is_held_out(id_col: str, modulus: int) -> Column:
    """True where the row's remainder is 2; a null id is never held out."""
    return F.coalesce(remainder(id_col, modulus) == 2, F.lit(False))


def utf8(text_col: str) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def with_found(rows: DataFrame, found: DataFrame, keys: list[str], rows_of: str) -> DataFrame:
    """``rows`` joined with ``found``, which has each key of ``rows`` once and in ``rows_of`` its number of rows.

    Keys of over a thousandth of all rows, of which there are at most 1,000,
    are broadcast; their rows are dealt by a number instead of the key, so no
    task gets a hot key. ``found`` must be a written table.
    """
    total = found.agg(F.sum(rows_of)).first()[0] or 0
    others = [c for c in found.columns if c not in keys]
    hot = found.filter(F.col(rows_of) * 1000 > total)
    named = lambda df, tag: df.select(*[F.col(k).alias(f"{tag}{k}") for k in keys], F.struct(*others).alias(f"{tag}found"))
    same = lambda tag: [F.col(k) == F.col(f"{tag}{k}") for k in keys]
    seen = rows.join(F.broadcast(named(hot, "hot_")), same("hot_"), "left")
    # a number for rows that are done, and for all others the same on both sides
    spare = F.when(F.col("hot_found").isNull(), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    cold = named(found.filter(F.col(rows_of) * 1000 <= total), "cold_").withColumn("cold_spare", F.lit(-1).cast("long"))
    met = seen.withColumn("spare", spare).join(cold, [*same("cold_"), F.col("spare") == F.col("cold_spare")], "left")
    best = F.coalesce("hot_found", "cold_found")
    return met.select(*rows.columns, *[best[c].alias(c) for c in others])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
