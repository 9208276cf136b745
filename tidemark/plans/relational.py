"""Filters, projections, joins, aggregates, windows, sorts, set operations and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, text, times
from ..operators import ingest, serve
from .fixtures import AS_OF
from .registry import query

BOX = (-60.0, -40.0, 120.0, 60.0)
VALID = """CASE WHEN source NOT IN ('gdelt','telegram','mastodon','adsb','ais','rss') THEN 'invalid source,' ELSE '' END ||
  CASE WHEN coalesce(source_id, '') = '' THEN 'missing source_id,' ELSE '' END || CASE WHEN coalesce(collected_at, 0) <= 0 THEN 'invalid collected_at,' ELSE '' END ||
  CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND (lat < -90 OR lat > 90) THEN 'invalid lat,' ELSE '' END ||
  CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND (lon < -180 OR lon > 180) THEN 'invalid lon,' ELSE '' END"""
EPOCH = "CAST(floor(epoch({})) AS BIGINT)"


def seconds(column):
    return times.epoch_seconds(F.col(column))


def r6(c):
    return F.round(c, 6)


@query("FLT-01", f"SELECT arrival, rtrim({VALID}, ',') AS errors FROM raw_records")
def validation(t):
    return t.raw_records.select("arrival", F.array_join(ingest.errors(), ",").alias("errors"))


PUBLISHED = """CASE WHEN id % 31 = 0 THEN ' ' WHEN id % 37 = 0 THEN 'soon' ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') END"""
DISPOSITION = f"""SELECT r.arrival, CASE WHEN r.source = 'mastodon' AND contains(r.source_id, 'emsc') THEN 'IGNORED' WHEN r.lat IS NULL OR r.lon IS NULL THEN 'NO_LOCATION'
  WHEN p IS NULL THEN 'MISSING_PUBLISHED_AT' WHEN r.collected_at <= 0 THEN 'INVALID_COLLECTED_AT' WHEN p = 'soon' THEN 'INVALID_PUBLISHED_AT'
  WHEN trim(p) = '' THEN 'MISSING_PUBLISHED_AT' WHEN e.id IS NOT NULL THEN 'DUPLICATE' ELSE 'INSERTED' END AS disposition
  FROM (SELECT *, {PUBLISHED} AS p FROM raw_records) r LEFT JOIN existing_items e ON r.source = e.source AND r.source_id = e.source_id"""


def dispositions(t):
    published = F.when(F.col("id") % 31 == 0, " ").when(F.col("id") % 37 == 0, "soon").otherwise(times.iso_text(F.col("published_at")))
    stored = t.existing_items.select("source", "source_id", F.lit(True).alias("stored"))
    joined = t.raw_records.withColumn("p", published).join(stored, ["source", "source_id"], "left")
    return joined.select("arrival", ingest.disposition(F.col("p"), F.col("stored").isNotNull()).alias("disposition"))


@query("FLT-02", DISPOSITION)
def disposition_cascade(t):
    return dispositions(t)


@query("FLT-03", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'emsc-' || event_id ELSE 'x' || event_id END AS i, event_id % 2 = 0 AS m FROM events) WHERE NOT (m AND contains(i, 'emsc'))")
def source_drop(t):
    e = F.col("event_id")
    rows = t.table("events").select(
        "event_id", F.when(e % 5 == 0, F.concat(F.lit("emsc-"), e)).otherwise(F.concat(F.lit("x"), e)).alias("source_id"),
        F.when(e % 2 == 0, "mastodon").otherwise("rss").alias("source"),
    )
    return rows.filter(~ingest.dropped_source()).select("event_id")


@query("FLT-04", "SELECT id FROM items WHERE lat IS NOT NULL AND lon IS NOT NULL")
def has_location(t):
    return t.items.filter(ingest.located()).select("id")


@query("FLT-06", f"SELECT cluster_id FROM clusters WHERE last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR")
def recent_clusters(t):
    return t.clusters.filter(F.col("last_seen_at") >= t.as_of - F.expr("INTERVAL 72 HOUR")).select("cluster_id")


@query("FLT-07", "SELECT id FROM assigned WHERE cluster_id IS NULL")
def unassigned(t):
    return t.assigned.filter("cluster_id IS NULL").select("id")


@query("FLT-08", "SELECT cluster_id FROM clusters WHERE first_seen_at >= TIMESTAMP '2024-01-02 12:00:00'")
def clusters_from(t):
    return t.clusters.filter(F.col("first_seen_at") >= F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")).select("cluster_id")


@query("FLT-10", "SELECT id FROM items WHERE lat BETWEEN -40 AND 60 AND lon BETWEEN -60 AND 120")
def in_box(t):
    return t.items.filter(geo.in_box(F.col("lat"), F.col("lon"), geo.check_box(BOX))).select("id")


@query("FLT-11", "SELECT geoname_id FROM places WHERE coalesce(try_cast(CASE WHEN geoname_id % 6 = 0 THEN 'n/a' ELSE population::VARCHAR END AS BIGINT), 0) >= 100000")
def min_population(t):
    given = F.when(F.col("geoname_id") % 6 == 0, "n/a").otherwise(F.col("population").cast("string"))
    return t.places.filter(F.coalesce(given.try_cast("bigint"), F.lit(0)) >= 100_000).select("geoname_id")


@query("FLT-12", f"SELECT cluster_id, coalesce(TIMESTAMP '2024-01-23 00:00:00' - l > INTERVAL 21 DAY, false) AS too_old FROM (SELECT cluster_id, CASE WHEN cluster_id NOT LIKE '%1' THEN last_seen_at END AS l FROM clusters)")
def too_old(t):
    last = F.when(~F.col("cluster_id").endswith("1"), F.col("last_seen_at"))
    return t.clusters.select("cluster_id", F.coalesce(F.lit("2024-01-23 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 21 DAY") > last, F.lit(False)).alias("too_old"))


@query("FLT-13", f"SELECT id, {EPOCH.format('published_at')} AS published FROM items WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR AND lat IS NOT NULL AND lon IS NOT NULL ORDER BY published_at DESC, id LIMIT 100")
def recent_located(t):
    found = t.items.filter(ingest.located() & (F.col("published_at") >= t.as_of - F.expr("INTERVAL 240 HOUR")))
    return found.orderBy(F.desc("published_at"), "id").limit(100).select("id", seconds("published_at").alias("published"))


@query("FLT-14", f"SELECT cluster_id, count(*) AS item_count FROM assigned WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND max(ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 360 HOUR")
def active_clusters(t):
    stats = t.assigned.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("item_count"), F.max("ts").alias("updated_at"))
    return stats.filter((F.col("updated_at") >= t.as_of - F.expr("INTERVAL 360 HOUR")) & (F.col("item_count") >= 2)).select("cluster_id", "item_count")


@query("FLT-15", "SELECT event_id, greatest(1, least(value, 60)) AS timeout FROM events")
def timeout_clamp(t):
    return t.table("events").select("event_id", F.greatest(F.lit(1), F.least("value", F.lit(60))).cast("double").alias("timeout"))


@query("FLT-16", "SELECT id FROM items WHERE lower(location_name) = 'nation_3' AND source = 'rss' ORDER BY id LIMIT 20")
def client_filters(t):
    return t.items.filter((F.lower("location_name") == "nation_3") & (F.col("source") == "rss")).orderBy("id").limit(20).select("id")


@query("FLT-17", "SELECT id FROM items WHERE lat IS NOT NULL AND NOT isnan(lat) AND lon IS NOT NULL AND NOT isnan(lon) AND source_id IS NOT NULL")
def drawable(t):
    finite = F.col("lat").isNotNull() & ~F.isnan("lat") & F.col("lon").isNotNull() & ~F.isnan("lon")
    return t.items.filter(finite & F.col("source_id").isNotNull()).select("id")


@query("FLT-18", "SELECT c.cluster_id FROM clusters c JOIN (SELECT cluster_id, count(*) n FROM assigned GROUP BY 1) a ON a.cluster_id = c.cluster_id WHERE c.lat <> 0 AND c.lon <> 0 AND n > 0")
def visible_clusters(t):
    counts = t.assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return t.clusters.join(counts, "cluster_id").filter("lat <> 0 AND lon <> 0 AND n > 0").select("cluster_id")


@query("PRJ-02", f"SELECT id, trim(coalesce(title, '') || ' ' || coalesce(body, '')) AS item_text, {EPOCH.format('coalesce(published_at, ts)')} AS created FROM items")
def clustering_item(t):
    return t.items.select("id", F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))).alias("item_text"), times.epoch_seconds(serve.event_time()).alias("created"))


@query("PRJ-03", f"SELECT id, source, source_id, collected_at, coalesce({EPOCH.format('published_at')}, 0) AS published, title, location_name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM items")
def api_item(t):
    return t.items.select("id", "source", "source_id", "collected_at", F.coalesce(seconds("published_at"), F.lit(0)).alias("published"), "title", "location_name", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query("PRJ-04", "SELECT cluster_id, title, lower(location_name) AS location_key FROM clusters")
def api_cluster(t):
    return t.clusters.select("cluster_id", "title", F.lower("location_name").alias("location_key"))


@query("PRJ-05", "SELECT id, coalesce(nullif(k, ''), nullif(regexp_replace(lower(n), '[^a-z0-9]', '', 'g'), ''), printf('%.2f_%.2f', lat, lon)) AS location_key FROM (SELECT *, CASE WHEN id % 3 = 0 THEN lower(location_name) ELSE '' END AS k, CASE WHEN id % 2 = 0 THEN location_name ELSE '' END AS n FROM items) WHERE lat IS NOT NULL")
def location_fallback(t):
    key = F.when(F.col("id") % 3 == 0, F.lower("location_name")).otherwise("")
    name = F.when(F.col("id") % 2 == 0, F.col("location_name")).otherwise("")
    made = F.coalesce(F.nullif(key, F.lit("")), F.nullif(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), F.lit("")), F.format_string("%.2f_%.2f", "lat", "lon"))
    return t.items.filter("lat IS NOT NULL").select("id", made.alias("location_key"))


@query("PRJ-06", "SELECT id, round(lon - 0.01, 6) AS min_lon, round(lat - 0.01, 6) AS min_lat, round(lon + 0.01, 6) AS max_lon, round(lat + 0.01, 6) AS max_lat FROM items WHERE lat IS NOT NULL")
def point_box(t):
    box = geo.point_box(F.col("lat"), F.col("lon"))
    names = ("min_lon", "min_lat", "max_lon", "max_lat")
    return t.items.filter("lat IS NOT NULL").select("id", *[r6(box[i]).alias(n) for i, n in enumerate(names)])


@query("PRJ-08", "SELECT CASE source WHEN 'rss' THEN 'news' ELSE source END AS label, count(*) AS n FROM items GROUP BY 1")
def source_label(t):
    return t.items.groupBy(F.when(F.col("source") == "rss", "news").otherwise(F.col("source")).alias("label")).agg(F.count("*").alias("n"))


@query("PRJ-09", "SELECT id, coalesce(nullif(CASE WHEN id % 4 = 0 THEN '' ELSE title END, ''), nullif(substring(body, 1, 100), ''), 'Untitled cluster') AS shown FROM items")
def display_title(t):
    title = F.when(F.col("id") % 4 == 0, "").otherwise(F.col("title"))
    return t.items.select("id", F.coalesce(F.nullif(title, F.lit("")), F.nullif(F.substring("body", 1, 100), F.lit("")), F.lit("Untitled cluster")).alias("shown"))


@query("JOIN-01", "SELECT c.cluster_id, count(a.id) AS n, coalesce(string_agg(a.id::VARCHAR, ',' ORDER BY a.published_at DESC NULLS FIRST, a.id), '') AS items FROM clusters c LEFT JOIN assigned a ON a.cluster_id = c.cluster_id GROUP BY 1")
def clusters_with_items(t):
    served = serve.clusters_since(t.clusters, t.assigned, limit=None)
    ids = F.array_join(F.transform(F.col("items"), lambda i: i["id"].cast("string")), ",")
    return served.select("cluster_id", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n"), F.coalesce(ids, F.lit("")).alias("items"))


@query("JOIN-02", "SELECT r.arrival FROM raw_records r WHERE NOT EXISTS (SELECT 1 FROM existing_items e WHERE e.source = r.source AND e.source_id = r.source_id)")
def anti_join(t):
    return ingest.unseen(t.raw_records, t.existing_items).select("arrival")


@query("JOIN-03", "SELECT geoname_id, alt_name FROM alt_names WHERE geoname_id IN (SELECT geoname_id FROM places)")
def semi_join(t):
    return t.alt_names.join(t.places, "geoname_id", "left_semi").select("geoname_id", "alt_name")


@query("JOIN-05", "SELECT id, name FROM (SELECT id * 7 % 2000 AS pid, id FROM items) JOIN places ON geoname_id = pid")
def by_id(t):
    return t.items.select("id", (F.col("id") * 7 % 2000).alias("geoname_id")).join(t.places, "geoname_id").select("id", "name")


KEEP_FIRST = "SELECT source, source_id, arg_min(title, arrival) AS title, min(arrival) AS arrival FROM raw_records GROUP BY 1, 2"


@query("JOIN-06", KEEP_FIRST)
def keep_first(t):
    return ingest.keep_first(t.raw_records).select("source", "source_id", "title", "arrival")


@query("JOIN-10", "SELECT i.id, round(c.lat, 6) AS lat, round(c.lon, 6) AS lon FROM assigned i JOIN clusters c USING (cluster_id)")
def founder_place(t):
    return t.assigned.drop("lat", "lon").join(t.clusters.select("cluster_id", "lat", "lon"), "cluster_id").select("id", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query("JOIN-11", "SELECT cluster_id, lower(location_name) AS location_key FROM clusters WHERE lower(location_name) IN ('nation_1', 'nation_5', 'nation_9', 'nation_24')")
def by_location(t):
    keys = t.spark.createDataFrame([("nation_1",), ("nation_5",), ("nation_9",), ("nation_24",)], "location_key string")
    return t.clusters.withColumn("location_key", F.lower("location_name")).join(F.broadcast(keys), "location_key").select("cluster_id", "location_key")


@query("AGG-01", "SELECT (SELECT count(*) FROM assigned) AS items, (SELECT count(cluster_id) FROM assigned) AS clustered, (SELECT count(*) FROM clusters) AS clusters")
def global_counts(t):
    items = t.assigned.agg(F.count("*").alias("items"), F.count("cluster_id").alias("clustered"))
    return items.crossJoin(t.clusters.agg(F.count("*").alias("clusters")))  # one row each


@query("AGG-02", "SELECT cluster_id, count(*) AS n FROM assigned WHERE cluster_id IS NOT NULL GROUP BY 1")
def per_cluster(t):
    return serve.located_stats(t.assigned).select("cluster_id", F.col("item_count").alias("n"))


@query("AGG-03", "SELECT cluster_id, round(nullif(avg(lat), 0), 8) AS lat, round(nullif(avg(lon), 0), 8) AS lon FROM assigned WHERE cluster_id IS NOT NULL GROUP BY 1")
def mean_place(t):
    # eight digits: means of hundredths over few members have no ties there
    return serve.located_stats(t.assigned).select("cluster_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@query("AGG-04", "SELECT cluster_id, location_name FROM (SELECT cluster_id, location_name, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, location_name) AS r FROM assigned WHERE cluster_id IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def top_name(t):
    return serve.located_stats(t.assigned).select("cluster_id", "location_name")


@query("AGG-05", f"SELECT cluster_id, {EPOCH.format('min(coalesce(published_at, ts))')} AS first_seen, {EPOCH.format('max(coalesce(published_at, ts))')} AS last_seen FROM assigned WHERE cluster_id IS NOT NULL GROUP BY 1")
def seen_range(t):
    return serve.located_stats(t.assigned).select("cluster_id", seconds("first_seen_at").alias("first_seen"), seconds("last_seen_at").alias("last_seen"))


@query("AGG-06", "SELECT a.cluster_id, count(*) AS n FROM assigned a WHERE a.cluster_id IN (SELECT cluster_id FROM clusters WHERE last_seen_at >= TIMESTAMP '2024-01-02 00:00:00') GROUP BY 1")
def recent_stats(t):
    touched = t.clusters.filter(F.col("last_seen_at") >= F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return serve.located_stats(t.assigned.join(touched.select("cluster_id"), "cluster_id", "left_semi")).select("cluster_id", F.col("item_count").alias("n"))


@query("AGG-07", f"SELECT disposition, count(*) AS n FROM ({DISPOSITION}) GROUP BY 1")
def disposition_counts(t):
    return dispositions(t).groupBy("disposition").agg(F.count("*").alias("n"))


@query("AGG-08", "SELECT lower(trim(name)) AS key, string_agg(DISTINCT geoname_id::VARCHAR, ',' ORDER BY geoname_id::VARCHAR) AS ids FROM places GROUP BY 1")
def postings(t):
    keyed = t.places.select(text.lookup_key(F.col("name")).alias("key"), F.col("geoname_id").cast("string").alias("id"))
    return keyed.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))


@query("AGG-09", "SELECT count(DISTINCT lower(trim(name))) AS keys, count(DISTINCT lower(trim(name)) || geoname_id) AS postings, count(DISTINCT geoname_id) AS records FROM places")
def gazetteer_totals(t):
    per = t.places.groupBy(text.lookup_key(F.col("name")).alias("key")).agg(F.count_distinct("geoname_id").alias("n"))
    totals = per.agg(F.count("*").alias("keys"), F.sum("n").alias("postings"))
    return totals.crossJoin(t.places.agg(F.count_distinct("geoname_id").alias("records")))  # one row each


COUNTED = "(SELECT c.*, coalesce(n, 0) AS item_count FROM clusters c LEFT JOIN (SELECT cluster_id, count(*) AS n FROM assigned GROUP BY 1) a USING (cluster_id))"
ROLLUP = f"""SELECT coalesce(nullif(lower(location_name), ''), '') AS location_key, round(arg_min(lat, cluster_id), 6) AS lat, round(arg_min(lon, cluster_id), 6) AS lon,
  arg_min(location_name, cluster_id) AS location_name, CAST(sum(item_count) AS BIGINT) AS item_count, string_agg(cluster_id, ',' ORDER BY cluster_id) AS clusters
  FROM {COUNTED} WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1"""


def rolled_up(t):
    counts = t.assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    counted = t.clusters.join(counts, "cluster_id", "left").withColumn("item_count", F.coalesce("n", F.lit(0)))
    return serve.rollup_by_location(counted)


@query("AGG-10", ROLLUP)
def location_rollup(t):
    return rolled_up(t).select("location_key", r6("lat").alias("lat"), r6("lon").alias("lon"), "location_name", "item_count", F.array_join("clusters", ",").alias("clusters"))


@query("AGG-11", f"SELECT count(*) AS locations, CAST(sum(item_count) AS BIGINT) AS items FROM ({ROLLUP})")
def location_totals(t):
    return rolled_up(t).agg(F.count("*").alias("locations"), F.sum("item_count").alias("items"))


@query("AGG-12", "SELECT location_name, count(*) AS n, arg_max(id, ts::VARCHAR || lpad(id::VARCHAR, 12, '0')) AS latest FROM items GROUP BY 1")
def latest_per_location(t):
    return t.items.groupBy("location_name").agg(F.count("*").alias("n"), F.max_by("id", F.struct("ts", "id")).alias("latest"))


@query("AGG-13", f"SELECT cluster_id, {EPOCH.format('min(published_at)')} AS earliest, {EPOCH.format('max(published_at)')} AS latest FROM assigned WHERE cluster_id IS NOT NULL GROUP BY 1")
def published_range(t):
    ends = t.assigned.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.min("published_at").alias("lo"), F.max("published_at").alias("hi"))
    return ends.select("cluster_id", seconds("lo").alias("earliest"), seconds("hi").alias("latest"))


@query("AGG-14", "SELECT source, coalesce(CASE WHEN id % 3 > 0 THEN id % 3 END, 0) AS theme, count(*) AS n FROM items GROUP BY 1, 2")
def per_source_theme(t):
    theme = F.coalesce(F.when(F.col("id") % 3 > 0, F.col("id") % 3), F.lit(0)).alias("theme")
    return t.items.groupBy("source", theme).agg(F.count("*").alias("n"))


@query("AGG-19", """WITH m AS (SELECT event_id, event_type AS k, event_id % 400 AS g FROM events), per AS (SELECT g, count(*) n, min(k) lo, max(k) hi FROM m GROUP BY 1),
  al AS (SELECT k, count(*) total FROM m GROUP BY 1) SELECT g AS marker_group, CASE WHEN s >= 100 THEN '99+' ELSE s::VARCHAR END AS badge FROM (SELECT g, CASE WHEN lo = hi THEN total ELSE n END AS s FROM per JOIN al ON al.k = per.lo)""")
def marker_badges(t):
    markers = t.table("events").select("event_type", (F.col("event_id") % 400).alias("marker_group"))
    return serve.badges(markers, "marker_group", "event_type")


@query("AGG-20", "SELECT source, count(*) AS n FROM items GROUP BY 1")
def per_source(t):
    return t.items.groupBy("source").agg(F.count("*").alias("n"))


@query("AGG-21", "SELECT user_id AS marker, count(*) AS hits FROM events GROUP BY 1")
def marker_hits(t):
    return t.table("events").groupBy(F.col("user_id").alias("marker")).agg(F.count("*").alias("hits"))


@query("WIN-01", "SELECT cluster_id, arg_max(id, coalesce(published_at, ts)::VARCHAR || lpad((1000000000 - id)::VARCHAR, 12, '0')) AS newest FROM assigned WHERE cluster_id IS NOT NULL GROUP BY 1")
def newest_item(t):
    newest = F.max_by("id", F.struct(serve.event_time().alias("at"), F.negate("id").alias("id")))
    return t.assigned.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(newest.alias("newest"))


@query("WIN-02", KEEP_FIRST)
def first_of_key(t):
    return ingest.keep_first(t.raw_records).select("source", "source_id", "title", "arrival")


@query("WIN-05", "SELECT id, array_to_string(list_slice(list_filter(string_split(title, ' '), lambda x: length(x) >= 3), 1, 5), ' ') AS mentions FROM items")
def first_mentions(t):
    return t.items.select("id", F.array_join(F.slice(F.filter(F.split("title", " "), lambda x: F.length(x) >= 3), 1, 5), " ").alias("mentions"))


@query("WIN-06", "SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS r FROM items) WHERE r <= 200")
def feed_cap(t):
    return ingest.first_per_key(t.items, ["source"], [F.col("id")], 200).select("source", "id")


@query("WIN-07", "SELECT country, geoname_id FROM (SELECT country, geoname_id, row_number() OVER (PARTITION BY country ORDER BY geoname_id) AS r FROM places) WHERE r <= 50")
def postings_cap(t):
    return ingest.first_per_key(t.places, ["country"], [F.col("geoname_id")], 50).select("country", "geoname_id")


@query("SORT-01", "SELECT cluster_id FROM clusters ORDER BY first_seen_at DESC, cluster_id LIMIT 60")
def newest_clusters(t):
    return t.clusters.orderBy(F.desc("first_seen_at"), "cluster_id").limit(60).select("cluster_id")


@query("SORT-02", "SELECT id, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC NULLS FIRST, id) AS place FROM assigned WHERE cluster_id IS NOT NULL")
def item_order(t):
    order = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_first("published_at"), "id")
    return t.assigned.filter("cluster_id IS NOT NULL").select("id", F.row_number().over(order).cast("long").alias("place"))


@query("SORT-03", "SELECT cluster_id FROM clusters ORDER BY last_seen_at DESC, cluster_id LIMIT 50")
def index_refresh(t):
    return t.clusters.orderBy(F.desc("last_seen_at"), "cluster_id").limit(50).select("cluster_id")


@query("SORT-04", "SELECT id FROM assigned WHERE cluster_id IS NULL ORDER BY collected_at DESC, id LIMIT 20")
def work_order(t):
    return t.assigned.filter("cluster_id IS NULL").orderBy(F.desc("collected_at"), "id").limit(20).select("id")


@query("SORT-05", f"SELECT c.cluster_id, {EPOCH.format('min(a.published_at)')} AS earliest FROM clusters c LEFT JOIN assigned a USING (cluster_id) GROUP BY 1 ORDER BY earliest DESC NULLS LAST, 1 LIMIT 500")
def clusters_by_earliest(t):
    earliest = t.assigned.groupBy("cluster_id").agg(seconds_min("published_at"))
    return t.clusters.select("cluster_id").join(earliest, "cluster_id", "left").orderBy(F.desc_nulls_last("earliest"), "cluster_id").limit(500)


def seconds_min(column):
    return F.min(times.epoch_seconds(F.col(column))).alias("earliest")


@query("SORT-06", f"SELECT id, coalesce({EPOCH.format('published_at')}, 0) AS happened FROM items ORDER BY happened DESC, id LIMIT 300")
def items_by_date(t):
    return t.items.select("id", F.coalesce(seconds("published_at"), F.lit(0)).alias("happened")).orderBy(F.desc("happened"), "id").limit(300)


@query("SORT-08", "SELECT lower(name) AS key, geoname_id FROM places ORDER BY 1, 2 LIMIT 1000")
def sorted_keys(t):
    return t.places.select(F.lower("name").alias("key"), "geoname_id").orderBy("key", "geoname_id").limit(1000)


@query("SET-01", "SELECT DISTINCT key, geoname_id FROM (SELECT lower(name) AS key, geoname_id FROM places UNION ALL SELECT lower(country), geoname_id FROM places UNION ALL SELECT lower(alt_name), geoname_id FROM alt_names)")
def key_union(t):
    p = t.places
    keys = p.select(F.lower("name").alias("key"), "geoname_id").unionByName(p.select(F.lower("country").alias("key"), "geoname_id"))
    return keys.unionByName(t.alt_names.select(F.lower("alt_name").alias("key"), "geoname_id")).distinct()


TOKENS = "list_distinct(string_split(lower({}), ' '))"


@query("SET-02", f"SELECT id, len(list_intersect({TOKENS.format('title')}, {TOKENS.format('body')})) AS common, len(list_distinct(list_concat({TOKENS.format('title')}, {TOKENS.format('body')}))) AS either FROM items")
def set_sizes(t):
    a, b = (F.split(F.lower(c), " ", -1) for c in ("title", "body"))
    return t.items.select("id", F.size(F.array_intersect(a, b)).cast("long").alias("common"), F.size(F.array_union(a, b)).cast("long").alias("either"))


@query("SET-03", """SELECT id, string_agg(w, ' ' ORDER BY p) AS words FROM (SELECT id, arg_min(w, p) AS w, min(p) AS p FROM (SELECT id, unnest(string_split(title, ' ')) AS w, unnest(range(1, len(string_split(title, ' ')) + 1)) AS p FROM items) GROUP BY id, lower(w)) GROUP BY 1""")
def distinct_words(t):
    return t.items.select("id", F.array_join(text.distinct_ignoring_case(F.split("title", " ", -1)), " ").alias("words"))


@query("SET-04", "SELECT id, 'remove' AS change FROM items WHERE id % 2 = 0 AND id % 3 <> 0 UNION ALL SELECT id, 'add' FROM items WHERE id % 3 = 0 AND id % 2 <> 0")
def snapshot_diff(t):
    ids = t.items.select("id")
    return serve.difference(ids.filter("id % 2 = 0"), ids.filter("id % 3 = 0"), "id")


@query("SET-05", f"SELECT id, len(list_intersect({TOKENS.format('title')}, {TOKENS.format('body')})) = len({TOKENS.format('title')}) AND len({TOKENS.format('title')}) = len({TOKENS.format('body')}) AS same FROM items")
def set_equality(t):
    a, b = (F.split(F.lower(c), " ", -1) for c in ("title", "body"))
    return t.items.select("id", ((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)).alias("same"))


@query("SNK-01", "SELECT id, '{\"source\":\"' || source || '\",\"source_id\":\"' || source_id || '\",\"collected_at\":' || collected_at || CASE WHEN lat IS NULL THEN '' ELSE ',\"located\":true' END || '}' AS value FROM items")
def queue_push(t):
    row = F.struct("source", "source_id", "collected_at", F.when(F.col("lat").isNotNull(), True).alias("located"))
    return t.items.select("id", F.to_json(row).alias("value"))


@query("SNK-02", f"WITH v AS (SELECT * FROM raw_records WHERE {VALID} = ''), k AS (SELECT source, source_id, min(arrival) AS arrival FROM v GROUP BY 1, 2) SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM existing_items e WHERE e.source = k.source AND e.source_id = k.source_id)")
def insert_or_ignore(t):
    return ingest.new_records(t.raw_records, t.existing_items).select("source", "source_id", "arrival")


@query("SNK-03", f"SELECT sha256(source || ':' || source_id) AS cluster_id, substring(item_text, 1, 200) AS title, location_name, CAST(0 AS BIGINT) AS item_count, {EPOCH.format('coalesce(published_at, ts)')} AS first_seen FROM items")
def create_clusters(t):
    made = serve.found_clusters(t.items, t.as_of)
    return made.select("cluster_id", "title", "location_name", "item_count", seconds("first_seen_at").alias("first_seen"))


@query("SNK-04", f"SELECT cluster_id, count(*) AS item_count, CAST(epoch(TIMESTAMP '{AS_OF}') AS INTEGER) AS last_seen FROM assigned WHERE cluster_id IS NOT NULL GROUP BY 1")
def persist_assignment(t):
    counts = t.assigned.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("item_count"))
    return counts.select("cluster_id", "item_count", times.epoch_seconds(t.as_of).cast("int").alias("last_seen"))


@query("SNK-05", f"SELECT a.id, CASE WHEN c.last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN a.cluster_id END AS cluster_id FROM assigned a LEFT JOIN clusters c USING (cluster_id)")
def cleanup(t):
    _, items = serve.expire(t.clusters, t.assigned, t.as_of, 7)
    return items.select("id", "cluster_id")


@query("SNK-06", "SELECT (SELECT count(*) FROM items) AS items_deleted, (SELECT count(*) FROM clusters) AS clusters_deleted")
def delete_counts(t):
    return t.items.agg(F.count("*").alias("items_deleted")).crossJoin(t.clusters.agg(F.count("*").alias("clusters_deleted")))  # one row each


@query("SNK-07", """SELECT cluster_id, '{"type":"Feature","kind":"Point","key":"' || lower(location_name) || '"}' AS feature, round(lon, 6) AS lon, round(lat, 6) AS lat FROM clusters WHERE lat IS NOT NULL AND lon IS NOT NULL""")
def geojson(t):
    made = serve.feature_collection(t.clusters)
    at = lambda path: F.get_json_object("feature", path)
    shown = F.concat(F.lit('{"type":"'), at("$.type"), F.lit('","kind":"'), at("$.geometry.type"), F.lit('","key":"'), at("$.properties.location_key"), F.lit('"}'))
    lon, lat = (r6(at(f"$.geometry.coordinates[{i}]").cast("double")) for i in (0, 1))
    return made.select("cluster_id", lon.alias("lon"), lat.alias("lat"), shown.alias("feature"))


@query("STM-05", KEEP_FIRST.replace("GROUP BY 1, 2", "WHERE (source, source_id) NOT IN (SELECT source, source_id FROM existing_items) GROUP BY 1, 2"))
def cross_batch_dedupe(t):
    return ingest.unseen(ingest.keep_first(t.raw_records), t.existing_items).select("source", "source_id", "title", "arrival")


@query("STM-07", f"SELECT cluster_id FROM clusters WHERE last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def state_eviction(t):
    alive, _ = serve.expire(t.clusters, t.assigned, t.as_of, 7)
    return alive.select("cluster_id")


@query("STM-08", "SELECT id, 'remove' AS change FROM items WHERE id % 4 = 0 UNION ALL SELECT id, 'add' FROM items WHERE id % 4 = 1")
def refresh_diff(t):
    ids = t.items.select("id")
    return serve.difference(ids.filter("id % 4 IN (0, 2, 3)"), ids.filter("id % 4 IN (1, 2, 3)"), "id")


@query("STM-09", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'red' WHEN event_id % 60 <= 30 THEN 'green' ELSE 'orange' END AS health FROM events")
def health_colour(t):
    online, age = F.col("event_id") % 11 != 0, F.col("event_id") % 60
    return t.table("events").select("event_id", F.when(~online, "red").when(age <= 30, "green").otherwise("orange").alias("health"))
