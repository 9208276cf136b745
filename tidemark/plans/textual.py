"""Text, time, geometry and payload functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, ngrams, payload, text, times
from ..functions.text import KEYWORDS, STOPWORDS
from ..operators import serve
from .fixtures import AS_OF
from .registry import query


def joined(array):
    return F.array_join(array, "|")


# The oracle's dialect has no look-around and ASCII word boundaries; these are its patterns.
NOISE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, 'https?://\S+', ' ', 'g'), '@[\p{{L}}\p{{N}}_]+', ' ', 'g'), '#[\p{{L}}\p{{N}}_]+', ' ', 'g'), '[\x{{1F000}}-\x{{1FAFF}}]+', ' ', 'g')"
WORDS = r"lower(trim(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}_\s%]', ' ', 'g'), '\s+', ' ', 'g')))"
STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
CONTENT = "list_filter(string_split({}, ' '), lambda w: length(w) >= 3 AND NOT list_contains(" + STOP + ", w))"
NUMBERS = r"list_filter(list_transform(regexp_extract_all({}, '\b(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)\b'), lambda x: replace(x, ',', '')), lambda x: length(x) <= 10)"
FAMILY = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in words)}) THEN '{name}'" for name, words in KEYWORDS.items()) + " END"
TWS = r"list_transform(regexp_extract_all({}, '\b[0-9]{{1,3}}\s*(?:hour|day|week|month|year)s?\b'), lambda x: regexp_extract(x, '[0-9]+') || regexp_extract(x, '[0-9\s]+([hdwmy])', 1))"
WORD_ROWS = f"SELECT id, unnest({CONTENT.format(WORDS.format(NOISE.format('lower(item_text)')))}) AS w FROM items"


@query("STR-01", f"SELECT id, {NOISE.format('item_text')} AS cleaned FROM items")
def noise(t):
    return t.items.select("id", text.strip_noise(F.col("item_text")).alias("cleaned"))


@query("STR-02", f"SELECT id, {WORDS.format('item_text')} AS words FROM items")
def words(t):
    return t.items.select("id", text.plain_words(F.col("item_text")).alias("words"))


@query("STR-03", f"SELECT id, array_to_string({NUMBERS.format('item_text')}, '|') AS nums FROM items")
def numbers(t):
    return t.items.select("id", joined(text.numbers(F.col("item_text"))).alias("nums"))


PERCENT_TEXT = "CASE id % 3 WHEN 0 THEN (id % 100) || '%x ' WHEN 1 THEN (id % 100) || ' % ' ELSE (id % 100) || ' %y' END"


@query("STR-04", f"SELECT id, array_to_string(list_transform(regexp_extract_all(p, '[0-9]{{1,3}}\\s*%[xy]'), lambda x: regexp_extract(x, '[0-9]+') || '%'), '|') AS pcts FROM (SELECT id, {PERCENT_TEXT} AS p FROM items)")
def percents(t):
    return t.items.select("id", joined(text.percents(F.expr(PERCENT_TEXT))).alias("pcts"))


@query("STR-05", f"SELECT id, array_to_string({TWS.format('item_text')}, '|') AS windows FROM items")
def time_windows(t):
    return t.items.select("id", joined(text.time_windows(F.col("item_text"))).alias("windows"))


CANON_CLEAN = NOISE.format("regexp_replace(trim(item_text), '(?i)^\\s*RT\\s+@[A-Za-z0-9_]+:\\s*', '')")
CANON = f"SELECT id, array_to_string(list_sort(list_distinct(list_concat({CONTENT.format(WORDS.format('c'))}, {NUMBERS.format('c')}, {TWS.format('c')}))), ' ') AS canon FROM (SELECT id, {CANON_CLEAN} AS c FROM items)"


@query("STR-06", CANON)
def canonical(t):
    return t.items.select("id", text.canonical(F.col("item_text")).alias("canon"))


@query("STR-09", r"SELECT page_id, array_to_string(regexp_extract_all(url, 'https?://\S+'), '|') AS urls, array_to_string(regexp_extract_all(lower(url), '\b(?:[a-z0-9-]+\.)+[a-z]{2,}\b'), '|') AS domains FROM pages")
def urls(t):
    return t.table("pages").select("page_id", joined(text.find_all(F.col("url"), text.URL)).alias("urls"), joined(text.find_all(F.lower("url"), text.DOMAIN)).alias("domains"))


@query("STR-10", r"SELECT id, array_to_string(regexp_extract_all(item_text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b'), '|') AS dates, array_to_string(regexp_extract_all(item_text, '\b(?:19[0-9]{2}|20[0-9]{2}|2100)\b'), '|') AS years FROM items")
def dates(t):
    c = F.col("item_text")
    return t.items.select("id", joined(text.find_all(c, text.ISO_DATE)).alias("dates"), joined(text.find_all(c, text.YEAR)).alias("years"))


DOMINANT = f"SELECT id, arg_min(f, (1000 - n) * 100 + first) AS family FROM (SELECT id, f, count(*) AS n, list_position([{', '.join(repr(k) for k in KEYWORDS)}], f) AS first FROM (SELECT id, {FAMILY} AS f FROM ({WORD_ROWS})) WHERE f IS NOT NULL GROUP BY 1, 2) GROUP BY 1"
SEMANTIC = f"""WITH w AS ({WORD_ROWS}), k AS (SELECT id, w, {FAMILY} AS f FROM w), dom AS ({DOMINANT}),
  tok AS (SELECT id, CASE WHEN f IS NOT NULL THEN f || ':' || w WHEN regexp_matches(w, '[0-9%]') OR length(w) >= 6 THEN w END AS tok FROM k UNION ALL SELECT id, 'primary_' || family FROM dom)
  SELECT id, string_agg(DISTINCT tok, '|' ORDER BY tok) AS tokens FROM tok WHERE tok IS NOT NULL GROUP BY 1"""


@query("STR-11", SEMANTIC)
def semantic(t):
    named = text.with_words(text.dealt(t.items.select("id", "item_text"), "id"), "item_text")
    return named.select("id", joined(text.semantic_tokens(F.col("words"), F.col("hits"))).alias("tokens"))


@query("AGG-17", DOMINANT)
def dominant(t):
    named = text.with_words(text.dealt(t.items.select("id", "item_text"), "id"), "item_text")
    # exploded, as Spark would else compute the whole family once more for the filter, and its words for each of its parts
    return named.select("id", F.explode_outer(F.array(text.dominant_family(F.col("hits")))).alias("family")).filter("family IS NOT NULL")


@query("STR-12", f"SELECT id, {WORDS.format(NOISE.format('lower(body)'))} AS cleaned FROM items")
def ngram_text(t):
    return t.items.select("id", text.ngram_text(F.col("body")).alias("cleaned"))


def gram_sql(table: str, column: str) -> str:
    """Every n-gram of whole cleaned texts; texts are cut into characters once."""
    cleaned = WORDS.format(NOISE.format(f"lower({column})"))
    rows = f"(SELECT id, string_split(' ' || c || ' ', '') AS p FROM (SELECT id, {cleaned} AS c FROM {table}) WHERE c <> '')"
    return " UNION ALL ".join(
        f"SELECT id, unnest(list_transform(range(1, len(p) - {n - 2}), lambda i: {' || '.join(f'p[i + {k}]' for k in range(n))})) AS gram FROM {rows}" for n in (3, 4, 5)
    )


GRAM_ROWS = gram_sql("items", "body")


@query("STR-13", f"SELECT id, gram, count(*) AS n FROM ({GRAM_ROWS}) GROUP BY 1, 2")
def grams(t):
    return ngrams.gram_counts(t.items, "id", "body")


def bucket_sql(rows: str) -> str:
    return f"SELECT id, CAST('0x' || substring(md5(gram), 1, 4) AS INTEGER) AS bucket, count(*) AS n FROM ({rows}) GROUP BY 1, 2"


BUCKETS = bucket_sql(GRAM_ROWS)


@query("AGG-16", BUCKETS)
def gram_counts(t):
    return ngrams.bucket_counts(t.items, "id", "body")


@query("MATH-04", f"SELECT id, bucket, round(1 + ln(1 + n), 6) AS w FROM ({BUCKETS})")
def gram_weights(t):
    return gram_counts(t).select("id", "bucket", F.round(geo.log_count(F.col("n")), 6).alias("w"))


@query("STR-16", "SELECT id, CASE WHEN length(body) > 100 THEN substring(body, 1, 100) || '...' ELSE body END AS short FROM items")
def ellipsis(t):
    return t.items.select("id", text.ellipsis(F.col("body"), 100).alias("short"))


@query("STR-17", "SELECT id, array_to_string(list_transform(regexp_extract_all(title, '[A-Za-z0-9]+'), lambda x: lower(x)), '|') AS tokens FROM items")
def ascii_tokens(t):
    return t.items.select("id", joined(text.ascii_tokens(F.col("title"))).alias("tokens"))


@query("STR-18", r"SELECT event_id, try_cast(regexp_extract('v=' || value || 'JS:8', '[-+]?[0-9]+(?:\.[0-9]+)?') AS DOUBLE) AS x FROM events")
def first_float(t):
    junk = F.concat(F.lit("v="), F.format_string("%.2f", "value"), F.lit("JS:8"))
    return t.table("events").select("event_id", text.first_float(junk).alias("x"))


@query("STR-19", "SELECT q, nullif(lower(trim(q)), '') AS key FROM place_queries")
def keys(t):
    return t.place_queries.select("q", text.lookup_key(F.col("q")).alias("key"))


@query("STR-20", r"SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || substring(u, length(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) + 1) AS url FROM (SELECT page_id, upper(url) AS u FROM pages)")
def normal_urls(t):
    return t.table("pages").select("page_id", text.normal_url(F.upper("url")).alias("url"))


TAGGED = "(CASE WHEN id % 2 = 0 THEN '#Tag' || id || ' x ' ELSE '' END) || '@Ann @bob @' || source || ' @Eve text #' || source_id"


@query("STR-21", rf"SELECT id, array_to_string(list_concat(list_transform(regexp_extract_all(s, '#([\p{{L}}\p{{N}}_]+)', 1), lambda x: lower(x)), list_slice(list_transform(regexp_extract_all(s, '@([\p{{L}}\p{{N}}_]+)', 1), lambda x: lower(x)), 1, 3)), '|') AS words FROM (SELECT id, {TAGGED} AS s FROM items)")
def keyword_lists(t):
    return t.items.select("id", joined(text.keywords(F.expr(TAGGED))).alias("words"))


MEDIA = "'https://m.example/' || id || CASE id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mp4?x=1' WHEN 2 THEN '.html' ELSE '' END"


@query("STR-22", f"SELECT id, CASE id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' ELSE 'link' END AS kind FROM (SELECT id, {MEDIA} AS u FROM items)")
def media(t):
    return t.items.select("id", text.media_type(F.expr(MEDIA)).alias("kind"))


@query("STR-23", "SELECT id, sha256(source || ':' || source_id) AS h FROM items")
def hashes(t):
    return t.items.select("id", text.record_hash(F.col("source"), F.col("source_id")).alias("h"))


@query("STR-24", "SELECT id, substring(body, 1, 150) AS preview, source || ': ' || substring(coalesce(title, 'Untitled'), 1, 50) AS popup FROM items")
def previews(t):
    popup = F.concat("source", F.lit(": "), F.substring(F.coalesce("title", F.lit("Untitled")), 1, 50))
    return t.items.select("id", F.substring("body", 1, 150).alias("preview"), popup.alias("popup"))


@query("DT-01", "SELECT id, strftime(make_timestamp(collected_at * 1000000), '%Y-%m-%d %H:%M:%S') AS at_utc FROM items")
def from_epoch(t):
    return t.items.select("id", F.date_format(times.from_epoch(F.col("collected_at")), "yyyy-MM-dd HH:mm:ss").alias("at_utc"))


ISO = "CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'not a time' WHEN 3 THEN '2024-01-0' || (id % 9 + 1) || 'T05:06:07Z' WHEN 4 THEN '2024010' || (id % 9 + 1) || 'T050607Z' ELSE '2024-01-0' || (id % 9 + 1) || ' 07:06:07+02:00' END"


@query("DT-02", f"SELECT id, CASE WHEN id % 6 >= 3 THEN '2024-01-0' || (id % 9 + 1) || ' 05:06:07' ELSE 'none' END AS parsed FROM (SELECT id, {ISO} AS s FROM items)")
def parse_iso(t):
    parsed = F.date_format(times.parse_iso(F.expr(ISO)), "yyyy-MM-dd HH:mm:ss")
    return t.items.select("id", F.coalesce(parsed, F.lit("none")).alias("parsed"))


@query("DT-04", f"SELECT id, strftime(coalesce(published_at, TIMESTAMP '{AS_OF}'), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM items")
def iso_text(t):
    return t.items.select("id", times.iso_text(F.coalesce("published_at", t.as_of)).alias("iso"))


@query("DT-05", "SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM items")
def twitter_time(t):
    written = F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    short = F.regexp_replace(written, "^[A-Za-z]+ ", "")
    parsed = F.try_to_timestamp(short, F.lit("MMM dd HH:mm:ss '+0000' yyyy")).cast("timestamp_ntz")
    # January is an hour ahead of UTC in Ljubljana
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Ljubljana"), parsed)
    return t.items.select("id", times.iso_text(parsed).alias("iso"), F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local"))


@query("DT-06", f"SELECT id, round(greatest(0, CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) / 3600.0, 6)::DOUBLE AS age FROM items")
def age(t):
    return t.items.select("id", F.round(times.age_hours(t.as_of, F.col("ts")), 6).alias("age"))


RELATIVE = "CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE strftime(p, '%Y-%m-%d') END"


@query("DT-07", f"SELECT id, {RELATIVE} AS shown FROM (SELECT id, TIMESTAMP '{AS_OF}' - to_seconds(id * id % 200000) AS p, id * id % 200000 AS s FROM items)")
def relative(t):
    then = F.timestamp_add("SECOND", F.negate(F.col("id") * F.col("id") % 200_000), t.as_of)
    return t.items.select("id", times.relative(t.as_of, then).alias("shown"))


@query("DT-08", f"SELECT id, ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AS day, ts >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR AS three, ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS week, ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS month FROM items")
def lookbacks(t):
    back = {"day": "24 HOUR", "three": "72 HOUR", "week": "7 DAY", "month": "30 DAY"}
    return t.items.select("id", *[(F.col("ts") >= t.as_of - F.expr(f"INTERVAL {span}")).alias(name) for name, span in back.items()])


HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


@query("MATH-01", f"SELECT id, round({HAVERSINE.format(a='lat', b='lon', c='46.05', d='14.5')}, 4) AS km FROM items WHERE lat IS NOT NULL")
def haversine(t):
    return t.items.filter("lat IS NOT NULL").select("id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(46.05), F.lit(14.5)), 4).alias("km"))


CORNERS = ", ".join(HAVERSINE.format(a="lat", b="lon", c=f"(lat {s} 0.01)", d=f"(lon {r} 0.01)") for s in "-+" for r in "-+")


@query("MATH-02", f"SELECT id, round(greatest({CORNERS}) / 1.852, 4) AS nm FROM items WHERE lat IS NOT NULL")
def covering_radius(t):
    box = geo.point_box(F.col("lat"), F.col("lon"))
    return t.items.filter("lat IS NOT NULL").select("id", F.round(geo.covering_radius_nm(*[box[i] for i in range(4)]), 4).alias("nm"))


@query("MATH-03", "SELECT event_id, round(pow(2.0, -value / 72.0), 6) AS w FROM events")
def decay(t):
    return t.table("events").select("event_id", F.round(geo.decay(F.col("value"), 72.0), 6).alias("w"))


@query("MATH-06", "SELECT geoname_id, round(CASE WHEN population > 0 THEN log10(population + 1) ELSE 0 END, 6) AS prior FROM places")
def population_prior(t):
    return t.places.select("geoname_id", F.round(geo.log_population(F.col("population")), 6).alias("prior"))


ERF = "sign({x}) * (1 - (((((1.061405429 * t + -1.453152027) * t) + 1.421413741) * t + -0.284496736) * t + 0.254829592) * t * exp(-{x} * {x}))"


@query("MATH-07", f"SELECT event_id, round({ERF.format(x='x')}, 6) AS y FROM (SELECT event_id, x, 1 / (1 + 0.3275911 * abs(x)) AS t FROM (SELECT event_id, value / 50 - 1 AS x FROM events))")
def erf(t):
    return t.table("events").select("event_id", F.round(geo.erf(F.col("value") / 50 - 1), 6).alias("y"))


@query("MATH-08", f"SELECT n, round({ERF.format(x='x')} * ln(n + 1.5) * 110000, 3) AS r FROM (SELECT n, x, 1 / (1 + 0.3275911 * abs(x)) AS t FROM (SELECT CAST(5e6 / 3e6 AS DOUBLE) AS x, n FROM (SELECT DISTINCT user_id % 120 AS n FROM events)))")
def circles(t):
    n = t.table("events").select((F.col("user_id") % 120).alias("n")).distinct()
    return n.select("n", F.round(geo.circle_radius(F.col("n"), F.lit(5e6)), 3).alias("r"))


@query("MATH-09", "SELECT n, round(ln(n + 1.5) * 20000, 3) AS r, CAST(CASE WHEN 100000.0 * n > 5000000 - 10000 THEN 5000000 - 10000 ELSE 100000.0 * n END AS DOUBLE) AS h FROM (SELECT DISTINCT user_id % 120 AS n FROM events)")
def cylinders(t):
    n = t.table("events").select((F.col("user_id") % 120).alias("n")).distinct()
    radius, height = geo.cylinder(F.col("n"), F.lit(5_000_000.0))
    return n.select("n", F.round(radius, 3).alias("r"), height.cast("double").alias("h"))


@query("MATH-10", f"SELECT id, round(1 - greatest(0.0, least(1.0, (CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) / 604800.0::DOUBLE)), 6) AS fresh FROM items")
def recency(t):
    seconds = times.epoch_seconds(t.as_of) - times.epoch_seconds(F.col("ts"))
    return t.items.select("id", F.round(geo.recency(seconds), 6).alias("fresh"))


@query("MATH-11", "SELECT event_id, round(1.6e8 / pow(2.0, value / 5), 3) AS height, round(log2(1.6e8 / (value + 1)), 6) AS zoom FROM events")
def zooms(t):
    e = t.table("events")
    return e.select("event_id", F.round(geo.height_of_zoom(F.col("value") / 5), 3).alias("height"), F.round(geo.zoom_of_height(F.col("value") + 1), 6).alias("zoom"))


LENIENT = "CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'ground' WHEN 2 THEN event_id || '.75' ELSE '-' || event_id || '.25' END"


@query("MATH-12", "SELECT event_id, CASE event_id % 4 WHEN 2 THEN event_id + 0.75 WHEN 3 THEN -event_id - 0.25 ELSE -1 END::DOUBLE AS f, CASE event_id % 4 WHEN 2 THEN event_id WHEN 3 THEN -event_id ELSE -1 END AS i FROM events")
def lenient(t):
    given = F.expr(LENIENT)
    return t.table("events").select("event_id", F.coalesce(geo.lenient_float(given), F.lit(-1.0)).alias("f"), F.coalesce(geo.lenient_int(given), F.lit(-1)).alias("i"))


MEDIA_JSON = """CASE WHEN id % 5 = 0 THEN 'oops' ELSE '["a' || id || '","b"]' END"""


@query("JSON-01", "SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE 'a' || id || '|b' END AS urls FROM items")
def json_arrays(t):
    return t.items.select("id", joined(payload.string_array(F.expr(MEDIA_JSON))).alias("urls"))


@query("JSON-02", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_objects(t):
    return t.table("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("JSON-03", "SELECT id, source, source_id, collected_at, coalesce(round(lat, 6), 999) AS lat FROM items")
def json_round_trip(t):
    row = F.to_json(F.struct("source", "source_id", "collected_at", "lat"))
    back = F.from_json(row, "source string, source_id string, collected_at bigint, lat double")
    read = t.items.select("id", back.alias("r")).select("id", "r.*")
    return read.withColumn("lat", F.coalesce(F.round("lat", 6), F.lit(999.0)))


BODY = """'{"name":"' || source || '","n":' || id || ',"nested":{"x":1},"long":"' || repeat('z', CAST(id % 400 AS INTEGER)) || '"}'"""


@query("JSON-04", "SELECT id, source AS name, CASE WHEN id % 400 > 200 THEN repeat('z', 200) || '…' ELSE repeat('z', CAST(id % 400 AS INTEGER)) END AS long, false AS nested FROM items")
def scalar_fields(t):
    made = payload.scalar_fields(F.expr(BODY))
    return t.items.select("id", made["name"].alias("name"), made["long"].alias("long"), F.map_contains_key(made, "nested").alias("nested"))


LOOSE = """CASE id % 3 WHEN 0 THEN '["p","q"]' WHEN 1 THEN '{"items":["p","q"]}' ELSE '{"features":["p","q"]}' END"""


@query("JSON-05", "SELECT id, 'p|q' AS rows FROM items")
def loose_lists(t):
    return t.items.select("id", joined(payload.loose_list(F.expr(LOOSE))).alias("rows"))


MESSAGE = """'{"MessageType":"' || message_type || '","Message":{"' || message_type || '":{"UserID":' || mmsi || ',"Sog":1.5}}}'"""


@query("JSON-06", "SELECT event_id, mmsi FROM vessel_messages")
def message_bodies(t):
    return t.vessel_messages.select("event_id", payload.message_vessel(F.expr(MESSAGE)).alias("mmsi"))


@query("ARR-01", "SELECT id, 'NAME=' || title || '|SOURCE=' || source AS flat FROM items")
def flat_features(t):
    features = F.create_map(F.lit("SOURCE"), F.array("source"), F.lit("NAME"), F.array("title"))
    return t.items.select("id", joined(payload.flatten_features(features)).alias("flat"))


@query("ARR-02", "SELECT c.cluster_id, a.id FROM clusters c JOIN assigned a USING (cluster_id)")
def flat_items(t):
    return serve.cluster_items(t.clusters, t.assigned).select("cluster_id", "id")


@query("ARR-03", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.5 WHEN event_id % 3 = 1 THEN 2.5 ELSE value END AS lat FROM events")
def position_chain(t):
    e = F.col("event_id")
    last, body = F.when(e % 3 == 0, 1.5), F.when(e % 3 == 1, 2.5)
    return t.table("events").select("event_id", F.coalesce(last, body, "value").alias("lat"))
