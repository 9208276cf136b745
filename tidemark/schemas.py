"""Declared schemas; nothing is inferred."""

from __future__ import annotations

RECORD = (
    "source string, source_id string, collected_at bigint, published_at string, title string, text string, url string, "
    "media_urls array<string>, author string, entities map<string,string>, location_name string, lat double, lon double, raw string"
)
#: Positional columns of a gazetteer dump; only some are kept.
PLACE_DUMP = (
    "geoname_id string, name string, ascii_name string, alternate_names string, lat string, lon string, feature_class string, "
    "feature_code string, country string, cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population string, "
    "elevation string, dem string, timezone string, modified string"
)
#: The sources a record may name.
SOURCES = ("gdelt", "telegram", "mastodon", "adsb", "ais", "rss")
