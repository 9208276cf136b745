"""Vessels and aircraft: last-known state and normalised positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import cells


def merge_vessels(messages: DataFrame, fields: tuple[str, ...] = ("sog",), order: str = "event_id", seen: str = "seen") -> DataFrame:
    """Per vessel: first and last time, last type, and each field's last value that is not null."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return messages.groupBy("mmsi").agg(
        F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.max_by("message_type", order).alias("last_message_type"), *last
    )


def subscribed(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``messages`` once for each subscription that wants them, with its ``subscription``.

    ``subscriptions``: subscription, min_lat, min_lon, max_lat, max_lon, and
    ``vessels`` and ``types``, arrays of what is wanted; null or empty wants
    all. A subscription of several boxes has a row for each; a message in more
    than one of them comes once. In a stream the table is read anew by each
    batch, so a change acts from the next one on.
    """
    met = cells.within_boxes(messages, subscriptions.select("subscription", "min_lat", "min_lon", "max_lat", "max_lon", "vessels", "types"))
    wants = lambda wanted, value: F.coalesce(F.size(wanted) == 0, F.lit(True)) | F.array_contains(wanted, F.col(value))
    return met.filter(wants("vessels", "mmsi") & wants("types", "message_type")).select(*messages.columns, "subscription").distinct()


def stop_rule(timeout: float) -> tuple[float, float]:
    """``(least seconds, stable seconds)`` of a snapshot: it ends when none new came for the second, after the first."""
    return max(1.0, min(5.0, 0.6 * timeout)), max(0.75, min(2.0, 0.2 * timeout))


def _first(json: Column, *names: str) -> Column:
    """The first of some fields that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{n}"), F.lit("")) for n in names])


def aircraft(raw: DataFrame, column: str = "value", provider: str = "adsb") -> DataFrame:
    """Normal rows of loose JSON objects; rows without id or place are dropped."""
    j = F.col(column)
    as_int, as_float = geo.lenient_int, geo.lenient_float
    get = lambda n: F.get_json_object(j, f"$.{n}")
    made = raw.select(
        F.lower(F.trim(_first(j, "icao", "hex", "icao24"))).alias("icao"),
        F.nullif(F.trim(_first(j, "flight", "call", "callsign")), F.lit("")).alias("callsign"),
        as_float(get("lat")).alias("lat"), as_float(get("lon")).alias("lon"),
        as_int(get("alt_baro")).alias("alt_baro_ft"), as_int(get("alt_geom")).alias("alt_geom_ft"),
        as_float(get("gs")).alias("speed_knots"), as_float(get("track")).alias("heading_deg"),
        as_int(_first(j, "baro_rate", "geom_rate", "rate")).alias("vertical_rate_fpm"),
        F.nullif(F.trim(get("squawk")), F.lit("")).alias("squawk"), F.nullif(F.trim(_first(j, "category", "t")), F.lit("")).alias("category"),
        as_int(get("seen_pos")).alias("seen_pos_sec"), as_int(get("seen")).alias("seen_sec"), as_float(get("rssi")).alias("rssi"),
        F.lit("adsb").alias("type"), F.lit(provider).alias("source"),
    )
    return made.filter("icao <> '' AND lat IS NOT NULL AND lon IS NOT NULL")
