"""Validate, de-duplicate, classify and store incoming records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..schemas import RECORD, SOURCES

KEY = ["source", "source_id"]


def located() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull()


def errors() -> Column:
    """All that is wrong with a record, in a fixed order."""
    bad = [
        (~F.col("source").isin(*SOURCES), "invalid source"),
        (F.coalesce(F.col("source_id"), F.lit("")) == "", "missing source_id"),
        (F.coalesce(F.col("collected_at"), F.lit(0)) <= 0, "invalid collected_at"),
        (located() & ~F.col("lat").between(-90, 90), "invalid lat"),
        (located() & ~F.col("lon").between(-180, 180), "invalid lon"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(text)) for test, text in bad]))


def dropped_source() -> Column:
    """One source's automatic quake reports are not wanted."""
    return (F.col("source") == "mastodon") & F.col("source_id").contains("emsc")


def disposition(published: Column, exists: Column) -> Column:
    """What becomes of a record; the first rule that holds decides. ``published`` is text."""
    parsed = times.parse_iso(published)
    return (
        F.when(dropped_source(), "IGNORED")
        .when(~located(), "NO_LOCATION")
        .when(published.isNull(), "MISSING_PUBLISHED_AT")
        .when(F.coalesce(F.col("collected_at"), F.lit(0)) <= 0, "INVALID_COLLECTED_AT")
        .when((F.trim(published) != "") & parsed.isNull(), "INVALID_PUBLISHED_AT")
        .when(F.trim(published) == "", "MISSING_PUBLISHED_AT")
        .when(exists, "DUPLICATE")
        .otherwise("INSERTED")
    )


def keep_first(records: DataFrame, keys: list[str] = KEY, arrival: str = "arrival") -> DataFrame:
    """The earliest arrival of each key.

    An aggregate rather than a window, so copies meet before the shuffle and a
    hot key never fills a task.
    """
    others = [c for c in records.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.col(arrival)).alias("first")
    return records.groupBy(*keys).agg(first).select(*[F.col(k) if k in keys else F.col(f"first.{k}").alias(k) for k in records.columns])


def unseen(records: DataFrame, stored: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Records whose key is not stored."""
    return records.join(stored.select(*keys), keys, "left_anti")


def new_records(records: DataFrame, stored: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Cheap filters first: valid, first of its key, not stored."""
    valid = records.filter(F.size(errors()) == 0).filter(~F.coalesce(dropped_source(), F.lit(False)))
    return unseen(keep_first(valid, arrival=arrival), stored)


def classified(records: DataFrame, stored: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Every record with its ``disposition``.

    Of a key's storable records the first is INSERTED and the others, or all
    if the key is in ``stored``, are DUPLICATE. Records that fail validation
    for another reason than those of ``disposition`` are INVALID.
    """
    judged = records.withColumn("disposition", disposition(F.col("published_at"), F.lit(False)))
    invalid = (F.col("disposition") == "INSERTED") & (F.size(errors()) > 0)
    judged = judged.withColumn("disposition", F.when(invalid, "INVALID").otherwise(F.col("disposition")))
    fresh = unseen(keep_first(judged.filter("disposition = 'INSERTED'").select(*KEY, arrival), arrival=arrival), stored)
    first = fresh.select(F.col(arrival).alias("_first"))
    met = judged.join(first, F.col(arrival) == F.col("_first"), "left")
    duplicate = (F.col("disposition") == "INSERTED") & F.col("_first").isNull()
    return met.withColumn("disposition", F.when(duplicate, "DUPLICATE").otherwise(F.col("disposition"))).drop("_first")


def parse_records(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(records, dead letters)`` of JSON lines: unknown fields are dropped, lines without required ones are dead."""
    parsed = lines.withColumn("r", F.from_json(column, RECORD))
    whole = F.col("r.source").isNotNull() & F.col("r.source_id").isNotNull() & F.col("r.collected_at").isNotNull()
    return parsed.filter(whole).select("r.*"), parsed.filter(~F.coalesce(whole, F.lit(False))).select(column)


def to_json_lines(records: DataFrame) -> DataFrame:
    """One JSON object per record; null fields are left out."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
