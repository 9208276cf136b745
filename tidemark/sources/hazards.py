"""Quake and hazard feeds: GeoJSON of any properties, held as VARIANT; windows that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times

# Windows of the quake feed, and the one that stands for any other name.
QUAKE_FEEDS = tuple(f"{size}_{window}" for size in ("all", "significant") for window in ("hour", "day", "week"))
ANY_QUAKE_FEED = "all_week"
# Forms of the hazard feed, and the one that stands for any other name.
HAZARD_FEEDS = ("geojson", "rss", "rss_24h", "rss_7d")


def quake_feed(name: Column) -> Column:
    """The window that a request means."""
    return F.when(name.isin(*QUAKE_FEEDS), name).otherwise(F.lit(ANY_QUAKE_FEED))


def hazard_feed(name: Column) -> Column:
    return F.when(name.isin(*HAZARD_FEEDS), name).otherwise(F.lit(HAZARD_FEEDS[0]))


def features(landed: DataFrame, column: str = "payload") -> DataFrame:
    """A row for each feature of landed FeatureCollections: ``position``, ``feature_id``, ``lat``, ``lon``, ``properties`` (VARIANT).

    Other columns of ``landed`` stay. A payload that is no JSON, or no object
    with an array of features, gives no row; a feature without a point has null
    coordinates.
    """
    others = [c for c in landed.columns if c != column]
    read = landed.select(*others, F.try_variant_get(F.try_parse_json(column), "$.features", "array<variant>").alias("features"))
    each = read.select(*others, F.posexplode("features").alias("position", "f"))
    at = lambda path, kind: F.try_variant_get("f", path, kind)
    return each.select(
        *others, "position", at("$.id", "string").alias("feature_id"), at("$.geometry.coordinates[1]", "double").alias("lat"),
        at("$.geometry.coordinates[0]", "double").alias("lon"), at("$.properties", "variant").alias("properties"),
    )


def collections(landed: DataFrame, feed: str = "feed", column: str = "payload") -> DataFrame:
    """What a client gets of each landed hazard payload: ``n_features`` of GeoJSON, or an empty collection and ``raw_xml``."""
    name = hazard_feed(F.col(feed))
    parsed = F.try_variant_get(F.try_parse_json(column), "$.features", "array<variant>")
    is_json = name == HAZARD_FEEDS[0]
    return landed.withColumns({"feed_type": name, "n_features": F.when(is_json, F.coalesce(F.size(parsed), F.lit(0))).otherwise(F.lit(0)), "raw_xml": F.when(~is_json, F.col(column))}).drop(column)


def quakes(landed: DataFrame) -> DataFrame:
    """``(quake_id, at, updated, magnitude, lat, lon)`` of every feature of quake windows, times from epoch milliseconds."""
    number = lambda name, kind: F.try_variant_get("properties", f"$.{name}", kind)
    moment = lambda name: F.timestamp_millis(number(name, "bigint"))
    return features(landed).filter("feature_id IS NOT NULL").select(F.col("feature_id").alias("quake_id"), moment("time").alias("at"), moment("updated").alias("updated"), number("mag", "double").alias("magnitude"), "lat", "lon")


def latest_quakes(found: DataFrame) -> DataFrame:
    """Each quake once, as last revised; windows overlap, so the same revision comes often."""
    others = [c for c in found.columns if c != "quake_id"]
    last = F.max_by(F.struct(*others), F.struct(F.coalesce("updated", "at"), "magnitude"))
    return found.groupBy("quake_id").agg(last.alias("q")).select("quake_id", "q.*")


def new_quakes(stream: DataFrame, late: str = "8 days") -> DataFrame:
    """Each quake of a stream once, when it is first heard of; revisions and later windows that hold it are dropped.

    State goes ``late`` behind the newest quake, more than the longest window.
    """
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["quake_id"])


def articles(landed: DataFrame, column: str = "payload") -> DataFrame:
    """A row for each article of landed article lists, under the names that records are made of; empty and bad payloads give none."""
    listed = landed.withColumn("_v", F.try_variant_get(F.try_parse_json(column), "$.articles", "array<variant>")).drop(column)
    each = listed.select(*[c for c in listed.columns if c != "_v"], F.posexplode("_v").alias("position", "_a"))
    names = ("url", "title", "seendate", "socialimage", "domain", "language", "sourcecountry")
    return each.select(*[c for c in each.columns if c != "_a"], *[F.try_variant_get("_a", f"$.{n}", "string").alias(n) for n in names])


def published(seen: Column) -> Column:
    """The time of a compact date such as 20240103T101500Z."""
    return times.parse_iso(seen)
