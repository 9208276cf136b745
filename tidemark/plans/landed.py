"""Payloads that land as files: written from the test tables, read back by the sources, checked by SQL over the tables."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyarrow import fs
from pyspark.sql import functions as F

from ..functions import geo, times
from ..operators import cells, gazetteer, ingest, live, similarity
from ..sources import connectors, feeds, hazards, landing, xml_feeds, zipped
from ..streaming import vessels, versions
from .fixtures import AS_OF
from .registry import query

#: Items of a feed file: more than a feed's cap, and few enough for one file.
PER_FEED = 300


def escaped(c):
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def feed_address(number):
    return F.concat(F.lit("https://feeds.example.com/"), number.cast("string"))


def written_feeds(t):
    """The items as feed files, RSS, Atom and RDF in turn, under their addresses; and one file that is no feed."""
    number = F.floor(F.col("id") / PER_FEED)
    title, link = F.concat(F.lit("<title>"), escaped(F.col("title")), F.lit("</title>")), F.concat(F.lit("https://x/"), "id")
    mail = F.concat(F.lit("<pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>"))
    zoned = F.concat(F.date_format(F.timestamp_add("HOUR", F.lit(2), F.col("published_at")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    none = F.lit("")
    rss = F.concat(F.lit("<item>"), title, F.lit("<link>"), link, F.lit("</link><description>d &amp; e</description>"), F.coalesce(mail, none), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), title, F.lit('<link rel="self" href="https://y/"/><link href="'), link, F.lit('"/><summary>d &amp; e</summary>'), F.coalesce(F.concat(F.lit("<updated>"), zoned, F.lit("</updated>")), none), F.lit("</entry>"))
    rdf = F.concat(F.lit("<item>"), title, F.lit("<link>"), link, F.lit("</link><description>d &amp; e</description>"), F.coalesce(F.concat(F.lit("<dc:date>"), zoned, F.lit("</dc:date>")), none), F.lit("</item>"))
    kind = F.col("feed") % 3
    rows = t.items.select(number.alias("feed"), "id", F.when(number % 3 == 0, rss).when(number % 3 == 1, atom).otherwise(rdf).alias("xml"))
    whole = rows.groupBy("feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "xml"))), lambda x: x["xml"]), "\n").alias("items"))
    name = F.concat(F.lit("Feed "), F.col("feed").cast("string"))
    framed = (
        F.when(kind == 0, F.concat(F.lit("<rss version='2.0'><channel><title>"), name, F.lit("</title>"), "items", F.lit("</channel></rss>")))
        .when(kind == 1, F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><title>"), name, F.lit("</title>"), "items", F.lit("</feed>")))
        .otherwise(F.concat(F.lit("<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>"), name, F.lit("</title></channel>"), "items", F.lit("</rdf:RDF>")))
    )
    files = whole.select(xml_feeds.file_name(feed_address(F.col("feed"))).alias("name"), framed.alias("content"))
    broken = t.spark.createDataFrame([("broken.xml", "<rss><channel><title>x</title><item><title>y</item></channel></rss>")], "name string, content string")
    path = landing.folder(t.spark, "feeds")
    landing.write_files(files.unionByName(broken), path).count()
    return path


@query("SRC-04", f"SELECT DISTINCT id // {PER_FEED} AS position, 'https://feeds.example.com/' || (id // {PER_FEED}) AS url, true AS landed FROM items")
def feed_list(t):
    """The list of feeds, and whether each has landed."""
    path, listed = written_feeds(t), landing.folder(t.spark, "feed-list")
    numbers = sorted(r[0] for r in t.items.select(F.floor(F.col("id") / PER_FEED)).distinct().collect())  # a few; the list is one file
    urls = json.dumps([f"https://feeds.example.com/{n}" for n in numbers] + [" ", None])
    landing.write_files(t.spark.createDataFrame([("feeds.json", urls)], "name string, content string"), listed).count()
    there = t.spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.lit(True).alias("landed"))
    found = xml_feeds.feed_urls(t.spark, listed).withColumn("file", xml_feeds.file_name(F.col("url"))).join(there, "file", "left")
    return found.select(F.col("position").cast("long").alias("position"), "url", F.coalesce("landed", F.lit(False)).alias("landed"))


@query(
    "SRC-06",
    rf"""SELECT 'Feed ' || f AS author, r - 1 AS position, 'https://x/' || id AS link, regexp_replace(title, '^\s+|\s+$', '', 'g') AS title, 'd & e' AS summary,
    strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published FROM (SELECT *, id // {PER_FEED} AS f, row_number() OVER (PARTITION BY id // {PER_FEED} ORDER BY id) AS r FROM items) WHERE r <= 200""",
)
def feed_entries(t):
    """The first 200 items of every landed feed, parsed from its bytes."""
    found = xml_feeds.feed_items(t.spark, written_feeds(t))
    return found.select("author", F.col("position").cast("long").alias("position"), "link", F.coalesce("title", F.lit("")).alias("title"), "summary", "published")


def articles_json(t):
    """Article lists of 50, as JSON texts."""
    article = F.struct(
        F.concat(F.lit("https://n/"), "id").alias("url"), F.col("title").alias("title"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://m/"), "id")).alias("socialimage"), F.lit("d").alias("domain"), F.lit("English").alias("language"),
    )
    lists = t.items.groupBy(F.floor(F.col("id") / 50).alias("number")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", article.alias("a")))), lambda x: x["a"]).alias("articles"))
    return lists.select("number", F.size("articles").alias("n"), F.to_json(F.struct("articles")).alias("payload"))


@query("SRC-11", "SELECT 'https://n/' || id AS source_id, title, CASE WHEN id % 2 = 0 THEN 'https://m/' || id ELSE '' END AS media, CAST(floor(epoch(ts)) AS BIGINT) AS published FROM items")
def article_lists(t):
    """Landed article lists as records; a body that is no list gives none."""
    bad = t.spark.createDataFrame([(-1, 0, ""), (-2, 0, "{}"), (-3, 0, "oops")], "number bigint, n int, payload string")
    made = feeds.gdelt_records(hazards.articles(articles_json(t).unionByName(bad)))
    return made.select("source_id", "title", F.array_join("media_urls", "|").alias("media"), times.epoch_seconds(hazards.published(F.col("published_at"))).alias("published"))


#: Windows of the quake feed in the fixture, and the hours by which each later one is revised.
QUAKE_WINDOWS = {"all_hour": 0, "all_day": 1, "significant_week": 2}


def quake_payloads(t):
    """Overlapping windows of features, 200 to a payload; a quake is revised from window to window."""
    e = t.table("events").withColumn("quake", F.col("event_id") % 5000)
    rows = None
    for rank, (feed, hours) in enumerate(QUAKE_WINDOWS.items()):
        millis = times.epoch_seconds(F.col("ts").cast("timestamp_ntz")) * 1000
        point = F.struct(F.lit("Point").alias("type"), F.array((F.col("quake") % 360 - 180).cast("double"), (F.col("quake") % 180 - 90).cast("double"), F.lit(10.0)).alias("coordinates"))
        properties = F.struct(millis.alias("time"), (millis + hours * 3_600_000).alias("updated"), (F.col("quake") % 9 + rank * 0.1).alias("mag"), F.concat(F.lit("place "), "quake").alias("place"))
        feature = F.struct(F.lit("Feature").alias("type"), F.concat(F.lit("us"), "quake").alias("id"), point.alias("geometry"), properties.alias("properties"))
        part = e.filter(F.col("event_id") % (rank + 1) == 0).select(F.lit(feed).alias("feed"), F.floor(F.col("event_id") / 200).alias("number"), F.struct("event_id", feature.alias("f")).alias("x"))
        rows = part if rows is None else rows.unionByName(part)
    lists = rows.groupBy("feed", "number").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["f"]).alias("features"))
    return lists.select("feed", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("payload"))


_QUAKES = "(SELECT event_id, event_id % 5000 AS quake, CAST(floor(epoch(ts)) AS BIGINT) AS seen, {} AS rank FROM events WHERE event_id % {} = 0)"
QUAKES = "(SELECT * FROM " + " UNION ALL SELECT * FROM ".join(_QUAKES.format(r, r + 1) for r in range(3)) + ")"


@query("SRC-24", f"SELECT 'us' || quake AS quake_id, arg_max(seen, (seen + rank * 3600) * 10 + rank) AS at_seconds, max(seen + rank * 3600) AS updated, round(quake % 9 + arg_max(rank, (seen + rank * 3600) * 10 + rank) * 0.1, 3)::DOUBLE AS magnitude FROM {QUAKES} GROUP BY quake")
def latest_quakes(t):
    """Each quake of overlapping windows once, as last revised."""
    found = hazards.latest_quakes(hazards.quakes(quake_payloads(t).drop("feed")))
    return found.select("quake_id", F.unix_seconds("at").alias("at_seconds"), F.unix_seconds("updated").alias("updated"), F.round("magnitude", 3).alias("magnitude"))


@query("SRC-13", f"SELECT 'us' || quake AS feature_id, 'place ' || quake AS place, (quake % 180 - 90)::DOUBLE AS lat, (quake % 360 - 180)::DOUBLE AS lon, count(*) AS n FROM {QUAKES} GROUP BY ALL")
def geo_features(t):
    """Features of landed GeoJSON, whose properties have no fixed schema."""
    found = hazards.features(quake_payloads(t))
    return found.groupBy("feature_id", F.variant_get("properties", "$.place", "string").alias("place"), "lat", "lon").agg(F.count("*").alias("n"))


@query(
    "SRC-23",
    """SELECT CASE WHEN n_nationkey % 5 < 4 THEN ['geojson', 'rss', 'rss_24h', 'rss_7d'][CAST(n_nationkey % 5 AS INTEGER) + 1] ELSE 'geojson' END AS feed_type, n_nationkey,
    CASE WHEN n_nationkey % 5 IN (0, 4) THEN n_nationkey % 3 ELSE 0 END AS n_features, CASE WHEN n_nationkey % 5 IN (1, 2, 3) THEN '<rss>' || n_name || '</rss>' END AS raw_xml FROM nation""",
)
def hazard_collections(t):
    """Hazard payloads in both forms; an unknown name means GeoJSON."""
    k = F.col("n_nationkey")
    name = F.when(k % 5 < 4, F.element_at(F.array(*map(F.lit, hazards.HAZARD_FEEDS)), (k % 5 + 1).cast("int"))).otherwise("other")
    feature = F.lit('{"type":"Feature","id":"a","properties":{}}')
    collection = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_repeat(feature, (k % 3).cast("int")), ","), F.lit("]}"))
    payload = F.when(name.isin("geojson", "other"), collection).otherwise(F.concat(F.lit("<rss>"), "n_name", F.lit("</rss>")))
    found = hazards.collections(t.table("nation").select("n_nationkey", name.alias("feed"), payload.alias("payload")))
    return found.select("feed_type", k.cast("long").alias("n_nationkey"), F.col("n_features").cast("long").alias("n_features"), "raw_xml")


PLACE_LINE = ["id", "name", "name", "", "lat", "lon", "feature_class", "feature_code", "country", "", "a1", "a2", "", "", "people", "", "", "", ""]
LAT, LON = "CAST(geoname_id * 37 % 18000 AS DOUBLE) / 100 - 90", "CAST(geoname_id * 91 % 36000 AS DOUBLE) / 100 - 180"


@query(
    "SRC-19",
    f"""SELECT geoname_id, name, name AS ascii_name, country, 'a' || (geoname_id % 7) AS admin1, '' AS admin2, round(({LAT})::FLOAT::DOUBLE, 3) AS lat, round(({LON})::FLOAT::DOUBLE, 3) AS lon,
    feature_class, feature_code, population FROM places WHERE geoname_id % 10 <> 0 AND geoname_id % 13 <> 0 AND geoname_id % 11 <> 0 AND population >= 1000""",
)
def place_dump(t):
    """The dump out of its archives: lines that do not parse are dropped, a population that does not is 0."""
    g = F.col("geoname_id")
    made = {
        "id": F.when(g % 10 == 0, "bad").otherwise(g.cast("string")), "name": F.col("name"), "lat": F.when(g % 13 == 0, "north").otherwise(F.col("lat").cast("string")), "lon": F.col("lon").cast("string"),
        "feature_class": F.col("feature_class"), "feature_code": F.col("feature_code"), "country": F.col("country"), "a1": F.concat(F.lit("a"), g % 7), "a2": F.lit(""),
        "people": F.when(g % 11 == 0, "many").otherwise(F.col("population").cast("string")), "": F.lit(""),
    }
    lines = t.places.select(F.concat_ws("\t", *[made[c] for c in PLACE_LINE]).alias("value")).union(t.spark.createDataFrame([("7\tshort",), ("",)], "value string"))
    path = landing.folder(t.spark, "places")
    zipped.write_members(lines, path, gazetteer.PLACES_MEMBER)
    return gazetteer.read_places(t.spark, path, 1000).withColumns({c: F.round(F.col(c).cast("double"), 3) for c in ("lat", "lon")})


@query("SRC-20", "SELECT geoname_id, alt_name FROM alt_names")
def alt_name_dump(t):
    lines = t.alt_names.select(F.concat_ws("\t", F.lit("1"), "geoname_id", F.lit("en"), "alt_name", F.lit("1")).alias("value"))
    path = landing.folder(t.spark, "alt-names")
    zipped.write_members(lines.union(t.spark.createDataFrame([("1\tx\ten\tbad",), ("1\t2\ten",)], "value string")), path, gazetteer.ALT_NAMES_MEMBER)
    return gazetteer.read_alt_names(t.spark, path)


EVENT_PLACE = "SELECT event_id, CAST(event_id * 37 % 18001 AS DOUBLE) / 100 - 90 AS lat, CAST(event_id * 91 % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST(user_id AS BIGINT) AS mmsi, event_type AS message_type FROM events"


def positions(t):
    e = F.col("event_id")
    return t.table("events").select(
        "event_id", (e * 37 % 18_001).cast("double").alias("_lat"), (e * 91 % 36_000).cast("double").alias("_lon"), F.col("user_id").cast("long").alias("mmsi"), F.col("event_type").alias("message_type")
    ).select("event_id", (F.col("_lat") / 100 - 90).alias("lat"), (F.col("_lon") / 100 - 180).alias("lon"), "mmsi", "message_type")


HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2))))"


@query("SRC-21", f"SELECT event_id, geoname_id, round(d, 3) AS distance_km FROM (SELECT event_id, geoname_id, 250 + geoname_id % 500 AS r, {HAVERSINE} AS d FROM ({EVENT_PLACE}) p, places c WHERE geoname_id % 7 = 0) WHERE d <= r")
def positions_around(t):
    """Positions within each centre's radius, over the date line and the poles, too."""
    centres = t.places.filter("geoname_id % 7 = 0").select("geoname_id", F.col("lat").alias("centre_lat"), F.col("lon").alias("centre_lon"), (250 + F.col("geoname_id") % 500).cast("double").alias("radius_km"))
    return cells.within_radius(positions(t), centres, digits=3).select("event_id", "geoname_id", "distance_km")


@query(
    "SRC-22",
    f"""SELECT DISTINCT event_id, 'n' || n_nationkey AS subscription FROM ({EVENT_PLACE}) p, nation WHERE lat BETWEEN n_nationkey * 5 - 90 AND n_nationkey * 5 - 70 AND lon BETWEEN n_nationkey * 7 - 180 AND n_nationkey * 7 - 140
    AND (n_nationkey % 3 <> 0 OR mmsi % 4 = n_nationkey % 4) AND (n_nationkey % 2 = 0 OR message_type IN ('click', 'view'))""",
)
def subscriptions(t):
    """Messages by subscription: boxes, vessels and kinds of messages."""
    k = F.col("n_nationkey")
    some = t.table("events").select(F.col("user_id").cast("long").alias("mmsi")).distinct().groupBy((F.col("mmsi") % 4).alias("rest")).agg(F.collect_list("mmsi").alias("vessels"))
    wanted = t.table("nation").select(
        F.concat(F.lit("n"), k).alias("subscription"), (k * 5 - 90).cast("double").alias("min_lat"), (k * 7 - 180).cast("double").alias("min_lon"), (k * 5 - 70).cast("double").alias("max_lat"),
        (k * 7 - 140).cast("double").alias("max_lon"), F.when(k % 3 == 0, k % 4).alias("rest"), F.when(k % 2 != 0, F.array(F.lit("click"), F.lit("view"))).alias("types"),
    ).join(F.broadcast(some), "rest", "left")  # four rows
    return live.subscribed(positions(t), wanted).select("event_id", "subscription")


@query("FLT-09", "SELECT id, CASE WHEN lon IS NULL OR NOT (lon - id % 3 < lon + 10 - id % 21 AND lon + 10 - id % 21 <= 180 AND lon - id % 3 >= -180) THEN 'longitudes must rise within -180 and 180' WHEN NOT (lat - 1 >= -90 AND lat + 2 <= 90) THEN 'latitudes must rise within -90 and 90' END AS fault FROM items")
def box_faults(t):
    lat, lon, i = F.col("lat"), F.col("lon"), F.col("id")
    return t.items.select("id", geo.box_fault(lon - i % 3, lat - 1, lon + 10 - i % 21, lat + 2).alias("fault"))


@query(
    "DT-03",
    f"""SELECT id, CASE id % 7 WHEN 0 THEN epoch(TIMESTAMP '{AS_OF}') - 3600 * (id % 50) WHEN 1 THEN epoch(TIMESTAMP '{AS_OF}') - 86400 * (id % 50) WHEN 2 THEN floor(epoch(ts)) WHEN 3 THEN floor(epoch(ts)) - 7200 END::BIGINT AS bound FROM items""",
)
def since_bounds(t):
    i, at = F.col("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    asked = F.when(i % 7 == 0, F.concat(F.lit(" "), i % 50, F.lit("h"))).when(i % 7 == 1, F.concat(i % 50, F.lit("D "))).when(i % 7 == 2, F.concat(at, F.lit("Z"))).when(i % 7 == 3, F.concat(at, F.lit("+02:00")))
    asked = asked.when(i % 7 == 4, "").when(i % 7 == 5, "12x")
    return t.items.select("id", times.epoch_seconds(times.since_bound(asked, t.as_of)).alias("bound"))


#: Seconds of the snapshots in the fixture, whose messages are minutes apart.
RULE = vessels.StopRule(least=3600, stable=5400, hard=86_400)


def snapshot_messages(t):
    return t.vessel_messages.select(F.concat(F.lit("s"), F.col("mmsi") % 5).alias("snapshot"), "mmsi", F.timestamp_seconds("seen").alias("at"), "event_id", "message_type", "sog")


@query(
    "STM-06",
    """WITH m AS (SELECT 's' || (mmsi % 5) AS snapshot, * FROM vessel_messages), f AS (SELECT snapshot, mmsi, min(seen) AS f FROM m GROUP BY 1, 2),
    s AS (SELECT snapshot, min(f) AS started FROM f GROUP BY 1), n AS (SELECT f.*, started, greatest(started + 3600, f + 5400) AS calm, lead(f) OVER (PARTITION BY f.snapshot ORDER BY f, mmsi) AS next
      FROM f JOIN s ON s.snapshot = f.snapshot WHERE f < started + 86400),
    e AS (SELECT snapshot, least(min(calm), any_value(started) + 86400) AS ends FROM n WHERE next IS NULL OR next >= calm GROUP BY 1)
    SELECT m.snapshot, mmsi, min(seen) AS first_seen, max(seen) AS last_seen, arg_max(message_type, seen * 1000000 + event_id) AS last_message_type, round(arg_max(sog, seen * 1000000 + event_id) FILTER (sog IS NOT NULL), 6) AS sog,
      count(*) AS messages FROM m JOIN e ON e.snapshot = m.snapshot WHERE seen < ends GROUP BY 1, 2""",
)
def vessel_snapshots(t):
    """Snapshots with the stop rule, of messages at rest; tests hold the stream against it."""
    found = vessels.snapshots(snapshot_messages(t), RULE)
    return found.withColumns({"first_seen": F.unix_seconds("first_seen"), "last_seen": F.unix_seconds("last_seen"), "sog": F.round("sog", 6)})


@query("CLU-05", f"SELECT asked, made, (SELECT count(*) FROM clusters WHERE last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR) AS n FROM (VALUES (0, 0), (200, 0), (300, 0), (301, 301), (500, 301), (700, 700)) v(asked, made)")
def index_versions(t):
    """Which version of the index batches at some times take, and how many entries it has."""
    store = versions.IndexVersions(t.spark, landing.folder(t.spark, "index"))
    start, out = datetime(2024, 1, 4), None
    for asked in (0, 200, 300, 301, 500, 700):
        made = store.refreshed(start + timedelta(seconds=asked), lambda: similarity.recent(t.clusters, t.as_of))
        # of the version, not of its rows, which it may have none of
        row = store.read(made).agg(F.lit(asked).alias("asked"), F.lit(int((made - start).total_seconds())).alias("made"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out.select(F.col("asked").cast("int").alias("asked"), F.col("made").cast("int").alias("made"), "n")


#: Batches of a trigger where a whole table of lists waits.
BACKLOG = 400


def landed_lists(t, path):
    """Article lists and RSS files with a manifest; one payload of each kind cannot be read."""
    lists = articles_json(t).select(F.concat(F.lit("list-"), F.lpad(F.col("number").cast("string"), 12, "0"), F.lit(".json")).alias("name"), "n", F.col("payload").alias("content"))
    bad = t.spark.createDataFrame([("list-x.json", 1, "oops")], "name string, n int, content string")
    rows = lists.unionByName(bad)
    landing.write_files(rows, path).count()
    listed = sorted((r["name"], r["n"]) for r in rows.select("name", "n").collect())  # a row for each landed file
    lines = "".join(json.dumps({"file": name, "entries": n, "fetched_at": 1_704_000_000}) + "\n" for name, n in listed)
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_output_stream(f"{folder}/{connectors.MANIFEST}") as f:
        f.write(lines.encode())


def connected(t):
    """The landed lists through a connector's stream: rows of every trigger under a folder of its own, with their batches."""
    path, home = landing.folder(t.spark, "lists"), landing.folder(t.spark, "connected")
    landed_lists(t, path)

    def sink(rows, trigger_id):
        rows.write.mode("overwrite").parquet(f"{home}/rows/of={trigger_id}")

    rows = connectors.stream(t.spark, "gdelt", path, f"{home}/progress.json", batches=BACKLOG)
    asked = rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{home}/checkpoint").trigger(processingTime="100 milliseconds").start()
    try:
        asked.processAllAvailable()
    finally:
        asked.stop()
    return t.spark.read.parquet(f"{home}/rows")


@query("SRC-01", "SELECT 'gdelt' AS source, 'https://n/' || id AS source_id, 1704000000::BIGINT AS collected_at, title FROM items")
def connector_records(t):
    """Records of a connector's stream; what cannot be read goes to the dead letters."""
    lines, _ = connectors.split(connected(t))
    good, _ = ingest.parse_records(lines)
    return good.select("source", "source_id", "collected_at", "title")


@query("STM-02", "SELECT b AS batch, least(250, (SELECT count(*) + 1 FROM items) - b * 250) AS n FROM (SELECT unnest(range(0, (SELECT CAST(ceil((count(*) + 1) / 250.0) AS BIGINT) FROM items))) AS b)")
def batch_sizes(t):
    """How many entries each batch took: 250, the last one what is left, with the one that cannot be read."""
    return connected(t).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"))
