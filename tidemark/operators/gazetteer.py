"""Gazetteer: dumps to records and name postings, exact lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import PLACE_DUMP
from ..sources import zipped


#: Members of the dumps.
PLACES_MEMBER, ALT_NAMES_MEMBER = "allCountries.txt", "alternateNamesV2.txt"


def _whole(c: Column) -> Column:
    """An unsigned whole number, or null."""
    return F.when(c.rlike(r"^\+?[0-9]+$"), c).try_cast("bigint")


def places_of(lines: DataFrame, min_population: int = 0) -> DataFrame:
    """Records of the dump's tab-separated ``value`` lines, by position.

    A line of fewer than 15 columns, or whose id or place does not parse, is
    dropped; a population that does not parse is 0; an empty class is ``?``.
    """
    cut = lines.select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 15)
    at = {name.split()[0]: F.col("c")[i] for i, name in enumerate(PLACE_DUMP.split(", "))}
    made = cut.select(
        _whole(at["geoname_id"]).alias("geoname_id"), at["name"].alias("name"), at["ascii_name"].alias("ascii_name"), at["country"].alias("country"),
        at["admin1"].alias("admin1"), at["admin2"].alias("admin2"), at["lat"].try_cast("float").alias("lat"), at["lon"].try_cast("float").alias("lon"),
        F.coalesce(F.nullif(F.substring(at["feature_class"], 1, 1), F.lit("")), F.lit("?")).alias("feature_class"), at["feature_code"].alias("feature_code"),
        F.coalesce(_whole(at["population"]), F.lit(0)).alias("population"),
    )
    return made.filter("geoname_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").filter(F.col("population") >= min_population)


def alt_names_of(lines: DataFrame) -> DataFrame:
    """``(geoname_id, alt_name)`` of ``value`` lines: the second and the fourth column; lines without them are dropped."""
    cut = lines.select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 4)
    return cut.select(_whole(F.col("c")[1]).alias("geoname_id"), F.col("c")[3].alias("alt_name")).filter("geoname_id IS NOT NULL")


def read_places(spark: SparkSession, path: str, min_population: int = 0, member: str = PLACES_MEMBER) -> DataFrame:
    """Records of a dump, a text file or a ZIP of it, which is read in ranges without unpacking."""
    return places_of(_dump_lines(spark, path, member), min_population)


def read_alt_names(spark: SparkSession, path: str, member: str = ALT_NAMES_MEMBER) -> DataFrame:
    return alt_names_of(_dump_lines(spark, path, member))


def _dump_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    return spark.read.text(path) if path.endswith(".txt") else zipped.member_lines(spark, path, member)


def postings(places: DataFrame, alt_names: DataFrame, names: tuple[str, ...] = ("name", "ascii_name")) -> DataFrame:
    """``(key, geoname_id)``, each pair once: names of records and alternates of known records."""
    keys = alt_names.join(places.select("geoname_id"), "geoname_id", "left_semi").select(F.col("alt_name").alias("key"), "geoname_id")
    for name in names:
        keys = keys.unionByName(places.select(F.col(name).alias("key"), "geoname_id"))
    return keys.withColumn("key", text.lookup_key(F.col("key"))).filter("key IS NOT NULL").distinct()


def write_index(index: DataFrame, path: str) -> None:
    """Sorted by key over ranges, so a lookup reads the files whose bounds hold its key."""
    index.repartitionByRange("key").sortWithinPartitions("key", "geoname_id").write.mode("overwrite").parquet(path)


def lookup(queries: DataFrame, index: DataFrame, places: DataFrame, limit: int = 50, column: str = "q") -> DataFrame:
    """Candidates of each query: records whose name is the key, the ``limit`` smallest ids of a key.

    Spark cuts a key's ids before it shuffles them, so a name that very many
    places share sends ``limit`` of them from each task.
    """
    wanted = queries.select(column).distinct().withColumn("key", text.lookup_key(F.col(column)))
    used = index.join(wanted.select("key").distinct(), "key", "left_semi")
    place = F.row_number().over(Window.partitionBy("key").orderBy("geoname_id"))
    ids = used.withColumn("place", place).filter(F.col("place") <= limit).drop("place")
    return wanted.join(ids, "key").select(column, "geoname_id").join(places, "geoname_id")
