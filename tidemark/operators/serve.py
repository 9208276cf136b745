"""Serving queries: clusters with items, rollups by place, statistics, maintenance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def event_time() -> Column:
    """When an item happened: published, else collected."""
    return F.coalesce("published_at", "ts")


def located_stats(items: DataFrame) -> DataFrame:
    """Per cluster: count, mean place (a mean of exactly 0 counts as none), most frequent place name, first and last time."""
    # sums of decimals do not depend on the order of rows
    exact = lambda c: F.col(c).cast("decimal(18,12)")
    per_name = items.filter("cluster_id IS NOT NULL").groupBy("cluster_id", "location_name").agg(
        F.count("*").alias("n"), F.sum(exact("lat")).alias("lat"), F.count("lat").alias("n_lat"), F.sum(exact("lon")).alias("lon"), F.count("lon").alias("n_lon"),
        F.min(event_time()).alias("first"), F.max(event_time()).alias("last"),
    )
    mean = lambda v: F.nullif(F.try_divide(F.sum(v).cast("double"), F.sum(f"n_{v}")), F.lit(0.0))
    # names tie by alphabet: max_by of (count, reversed order) is a min_by of (-count, name)
    top = F.min_by("location_name", F.when(F.col("location_name").isNotNull(), F.struct(-F.col("n"), F.col("location_name"))))
    return per_name.groupBy("cluster_id").agg(
        F.sum("n").alias("item_count"), mean("lat").alias("lat"), mean("lon").alias("lon"), top.alias("location_name"),
        F.min("first").alias("first_seen_at"), F.max("last").alias("last_seen_at"),
    )


def clusters_since(clusters: DataFrame, items: DataFrame, since: datetime | None = None, limit: int | None = 1000, location_key: str | None = None) -> DataFrame:
    """Newest clusters with their items as an array, newest first, rows without a time first.

    The limit is taken before the join, so only the served clusters' items are
    gathered; None serves all. An array per cluster suits a page of clusters;
    ``cluster_items`` has the same as rows.
    """
    if since is not None:
        clusters = clusters.filter(F.col("first_seen_at") >= F.lit(since).cast("timestamp_ntz"))
    if location_key is not None:
        clusters = clusters.filter(F.lower("location_name") == location_key)
    top = clusters if limit is None else clusters.orderBy(F.desc("first_seen_at"), "cluster_id").limit(limit)
    item = F.struct(
        F.when(F.col("published_at").isNull(), 0).otherwise(1).alias("has_time"), F.negate(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("published_at"))).alias("rank"),
        "id", "source", "source_id", "title", "published_at", "lat", "lon", "location_name",
    )
    nested = items.join(top.select("cluster_id"), "cluster_id", "left_semi").groupBy("cluster_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return top.join(nested, "cluster_id", "left")


def cluster_items(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each item of each cluster; nothing of a cluster is gathered, however many items it has."""
    return items.join(clusters.select("cluster_id"), "cluster_id")


def location_key(name: str = "location_name", lat: str = "lat", lon: str = "lon") -> Column:
    """Lower-case name, else its letters and digits, else the place at two decimals."""
    return F.coalesce(F.nullif(F.lower(name), F.lit("")), F.format_string("%.2f_%.2f", lat, lon))


def feature_collection(clusters: DataFrame) -> DataFrame:
    """One GeoJSON text per cluster with coordinates."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    properties = F.struct("cluster_id", "title", F.col("location_name").alias("representative_location_name"), F.lower("location_name").alias("location_key"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    return clusters.filter("lat IS NOT NULL AND lon IS NOT NULL").select("cluster_id", F.to_json(feature).alias("feature"))


def rollup_by_location(clusters: DataFrame) -> DataFrame:
    """Per location key: the first cluster's place and name, items in all, and the clusters."""
    first = F.min_by(F.struct("lat", "lon", "location_name"), F.col("cluster_id"))
    return (
        clusters.filter("lat IS NOT NULL AND lon IS NOT NULL")
        .groupBy(location_key().alias("location_key"))
        .agg(first.alias("f"), F.sum("item_count").alias("item_count"), F.array_sort(F.collect_list("cluster_id")).alias("clusters"))
        .select("location_key", "f.lat", "f.lon", "f.location_name", "item_count", "clusters")
    )


def expire(clusters: DataFrame, items: DataFrame, as_of: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Clusters still alive, and items whose dead clusters are unset."""
    alive = clusters.filter(~F.coalesce(F.col("last_seen_at") < as_of - F.make_dt_interval(F.lit(days)), F.lit(False)))
    kept = alive.select("cluster_id", F.lit(True).alias("_alive"))
    freed = items.join(kept, "cluster_id", "left").withColumn("cluster_id", F.when(F.col("_alive"), F.col("cluster_id"))).drop("_alive")
    return alive, freed


def found_clusters(items: DataFrame, as_of: Column) -> DataFrame:
    """Cluster rows of founding items; ids are hashes of the founder's key, so a rerun gives the same."""
    title = F.coalesce(F.nullif(F.substring("item_text", 1, 200), F.lit("")), F.lit("No title"))
    return items.select(
        text.record_hash(F.col("source"), F.col("source_id")).alias("cluster_id"), title.alias("title"), "lat", "lon", "location_name",
        F.lit(0).cast("long").alias("item_count"), event_time().alias("first_seen_at"), event_time().alias("last_seen_at"), as_of.alias("updated_at"),
    )


def difference(shown: DataFrame, answer: DataFrame, key: str) -> DataFrame:
    """What a client must remove and add to show ``answer`` instead of ``shown``."""
    gone = shown.join(answer, key, "left_anti").select(key, F.lit("remove").alias("change"))
    return gone.unionByName(answer.join(shown, key, "left_anti").select(key, F.lit("add").alias("change")))


def badges(markers: DataFrame, group: str, key: str) -> DataFrame:
    """Count shown on a group of markers: of its key everywhere if it has only one, else of the group; ``99+`` from 100."""
    per = markers.groupBy(group).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("named"))
    everywhere = markers.groupBy(F.col(key).alias("lo")).agg(F.count("*").alias("total"))
    shown = F.when((F.col("lo") == F.col("hi")) & (F.col("named") == F.col("n")), F.col("total")).otherwise(F.col("n"))
    return per.join(everywhere, "lo", "left").select(group, F.when(shown >= 100, "99+").otherwise(shown.cast("string")).alias("badge"))
