"""Rank a query's candidates and pick its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from . import gazetteer

# Aliases of countries.
COUNTRY_ALIASES = {"us": "US", "usa": "US", "unitedstates": "US", "uk": "GB", "uae": "AE"}
# Words that ask for a kind of feature, its class and code beginnings.
INTENTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "river": ("H", ("STM", "STMI", "WAD")),
    "lake": ("H", ("LK", "LKI", "LKS")),
    "mount": ("T", ()),
    "mountain": ("T", ()),
    "city": ("P", ()),
    "town": ("P", ()),
    "country": ("A", ("PCL",)),
}


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def name_score(query: Column, name: Column) -> Column:
    """5 for equal, 3 for a beginning, else twice the share of query tokens in the name."""
    q, n = F.lower(text.strip(query)), F.lower(text.strip(name))
    qt, nt = F.array_distinct(text.ascii_tokens(q)), text.ascii_tokens(n)
    overlap = F.try_divide(F.size(F.array_intersect(qt, nt)), F.size(qt))
    return (
        F.when((q == "") | (n == "") | q.isNull() | n.isNull(), 0.0)
        .when(q == n, 5.0)
        .when(n.startswith(q), 3.0)
        .otherwise(2.0 * F.coalesce(overlap, F.lit(0.0)))
    )


def country_bias(tokens: Column) -> Column:
    """Alias of the tokens joined, else of the first token that is an alias or two letters."""
    aliases = _map(COUNTRY_ALIASES)
    each = F.transform(tokens, lambda w: F.coalesce(aliases[w], F.when(w.rlike("^[a-z]{2}$"), F.upper(w))))
    return F.coalesce(aliases[F.array_join(tokens, "")], F.get(F.array_compact(each), F.lit(0)))


def intent(tokens: Column) -> Column:
    """The first token that asks for a kind of feature."""
    known = F.array(*map(F.lit, INTENTS))
    return F.get(F.filter(tokens, lambda w: F.array_contains(known, w)), F.lit(0))


def feature_score(feature_class: Column, feature_code: Column, asked: Column) -> Column:
    out = F.lit(0.0)
    for word, (wanted, prefixes) in INTENTS.items():
        score = F.when(F.upper(F.coalesce(feature_class, F.lit(""))) == wanted, 2.5).otherwise(-2.5)
        if prefixes:
            begins = F.lit(False)
            for p in prefixes:
                begins = begins | F.upper(F.coalesce(feature_code, F.lit(""))).startswith(p)
            score = score + F.when(begins, 2.0).otherwise(-1.0)
        out = F.when(asked == word, score).otherwise(out)
    return out


def country_score(country: Column, bias: Column) -> Column:
    return F.when(bias.isNull(), 0.0).when(F.upper(F.coalesce(country, F.lit(""))) == bias, 2.5).otherwise(-1.5)


def is_country(feature_class: Column, feature_code: Column) -> Column:
    return F.coalesce((F.upper(feature_class) == "A") & F.upper(feature_code).startswith("PCL"), F.lit(False))


def scored(candidates: DataFrame, column: str = "q") -> DataFrame:
    """Candidates with their tokens, intent and general score."""
    q, tokens = F.col(column), text.ascii_tokens(F.col(column))
    c = candidates.withColumns({"tokens": tokens, "asked": intent(tokens), "is_country": is_country(F.col("feature_class"), F.col("feature_code"))})
    score = (
        3.0 * (
            name_score(q, F.col("name"))
            + feature_score(F.col("feature_class"), F.col("feature_code"), F.col("asked"))
            + country_score(F.col("country"), country_bias(F.col("tokens")))
        )
        + 0.8 * geo.log_population(F.col("population"))
        + F.when(F.col("is_country"), 4.0).otherwise(0.0)
        + F.when(F.col("is_country") & (F.col("asked") == "country"), 6.0).otherwise(0.0)
    )
    return c.withColumn("score", score)


def resolve(queries: DataFrame, index: DataFrame, places: DataFrame, limit: int = 50, column: str = "q") -> DataFrame:
    """The place of each query that has one: name, coordinates, area and a score from 1 to 10.

    A query of one token without an intent prefers a country of that name. Ties
    go to the smallest id. Both choices are aggregates, so candidates are
    reduced before they are shuffled.
    """
    asked = queries.select(column).distinct().filter((F.length(text.strip(F.col(column))) >= 2) & (F.size(text.ascii_tokens(F.col(column))) > 0))
    found = scored(gazetteer.lookup(asked, index, places, limit, column), column).filter("lat IS NOT NULL AND lon IS NOT NULL")
    overlap = F.size(F.array_intersect(F.array_distinct(text.ascii_tokens(F.lower("name"))), F.col("tokens")))
    matched = name_score(F.array_join("tokens", " "), F.col("name"))
    prefers = F.col("is_country") & (F.size("tokens") == 1) & F.col("asked").isNull()
    place = F.struct("name", "lat", "lon", "feature_class", "score")
    best = found.groupBy(column).agg(
        F.max_by(place, F.struct("score", F.negate("geoname_id"))).alias("general"),
        F.max_by(place, F.when(prefers, F.struct(overlap.alias("o"), F.col("population").alias("p"), matched.alias("m"), F.negate("geoname_id").alias("g")))).alias("country"),
    )
    area = F.when(F.upper("general.feature_class") == "P", 0.1).when(F.upper("general.feature_class") == "A", 0.5).otherwise(0.2)
    is_country_pick = F.col("country").isNotNull()
    return best.select(
        column,
        F.coalesce("country.name", "general.name").alias("name"),
        F.coalesce("country.lat", "general.lat").alias("lat"),
        F.coalesce("country.lon", "general.lon").alias("lon"),
        F.when(is_country_pick, 0.5).otherwise(area).alias("area"),
        F.when(is_country_pick, 10.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(10.0), 1 + F.col("general.score") / 5))).alias("score"),
    )


def first_resolved(mentions: DataFrame, resolved: DataFrame, key: str = "id", column: str = "mentions", most: int = 5) -> DataFrame:
    """Per row the first of its first ``most`` mentions that resolves."""
    each = mentions.select(key, F.posexplode(F.slice(column, 1, most)).alias("pos", "q"))
    return each.join(resolved, "q").groupBy(key).agg(F.min_by(F.struct("q", "name", "lat", "lon"), F.col("pos")).alias("p")).select(key, "p.*")


def wanted_mentions(entities: Column) -> Column:
    """Texts of place entities worth a lookup: not short, not stop words, not one lower-case token."""
    kept = F.filter(
        entities,
        lambda e: e["label"].isin("LOC", "GPE") & (F.length(e["text"]) >= 3) & ~F.lower(e["text"]).isin("man", "it", "der")
        & ~(~e["text"].contains(" ") & (e["text"] == F.lower(e["text"]))),
    )
    return text.distinct_ignoring_case(F.transform(kept, lambda e: e["text"]))


def enriched(records: DataFrame, entities: Column, index: DataFrame, places: DataFrame, key: list[str], limit: int = 50) -> DataFrame:
    """``records`` with ``location_name``, ``lat`` and ``lon`` of the first mentioned place that resolves, where they had no place.

    ``entities`` is an array<struct<label, text>> column over title and text;
    records with a place, or without any text, are left as they are.
    """
    lacking = (F.col("lat").isNull() | F.col("lon").isNull()) & (F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("text"), F.lit(""))).isNotNull())
    asked = records.filter(lacking).select(F.struct(*key).alias("id"), wanted_mentions(entities).alias("mentions"))
    queries = asked.select(F.explode(F.slice("mentions", 1, 5)).alias("q")).distinct()
    found = first_resolved(asked, resolve(queries, index, places, limit)).select(*[F.col(f"id.{k}").alias(f"_{k}") for k in key], F.struct("name", "lat", "lon").alias("_place"))
    met = records.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left")
    has = F.col("_place").isNotNull()
    return met.withColumns({
        "location_name": F.when(has, F.col("_place.name")).otherwise(F.col("location_name")),
        "lat": F.when(has, F.col("_place.lat")).otherwise(F.col("lat")), "lon": F.when(has, F.col("_place.lon")).otherwise(F.col("lon")),
    }).select(*records.columns)
