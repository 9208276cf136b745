"""Columns over loose payloads: JSON text, maps, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_array(json: Column) -> Column:
    """A JSON array of strings; malformed text is an empty array."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def string_map(json: Column) -> Column:
    """A JSON object with its values as text; malformed text is null."""
    return F.from_json(json, "map<string,string>")


def scalar_fields(json: Column, longest: int = 200) -> Column:
    """The top-level scalars of an object, as text; long ones are cut and marked."""
    fields = F.map_filter(string_map(json), lambda _, v: ~F.coalesce(v.rlike(r"^[\[{]"), F.lit(False)))
    return F.transform_values(fields, lambda _, v: F.when(F.length(v) > longest, F.concat(F.left(v, F.lit(longest)), F.lit("…"))).otherwise(v))


def loose_list(json: Column) -> Column:
    """The rows of an answer: an array, ``items``, ``features``, or an object's values."""
    as_list = F.from_json(json, "array<string>")
    held = [F.from_json(F.get_json_object(json, f"$.{k}"), "array<string>") for k in ("items", "features")]
    return F.coalesce(as_list, *held, F.map_values(string_map(json)), F.array().cast("array<string>"))


def message_body(message: Column) -> Column:
    """A vessel message's body, the field of ``Message`` that its type names."""
    bodies = string_map(F.get_json_object(message, "$.Message"))
    return bodies[F.get_json_object(message, "$.MessageType")]


def message_vessel(message: Column) -> Column:
    return F.get_json_object(message_body(message), "$.UserID").try_cast("bigint")


def flatten_features(features: Column) -> Column:
    """``{label: [values]}`` as sorted ``label=value``."""
    pairs = F.transform(F.map_entries(features), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit("="), v)))
    return F.array_sort(F.flatten(pairs))
