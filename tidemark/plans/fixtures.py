"""Domain tables derived from the test tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, times

AS_OF = "2024-01-04 00:30:00"
FOUNDED_BY = ["location_name", "source", "event_type"]
PAIRS = {"signup": "protest", "error": "blackout", "click": "sanctions", "view": "footage", "purchase": "killed"}


class Tables:
    """The tables of one folder and what is derived from them. Times are zoneless UTC."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.index: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp_ntz")

    @cached_property
    def items(self) -> DataFrame:
        d, e, n = self.table("documents"), self.table("events"), self.table("nation")
        keyword = F.create_map(*[F.lit(x) for kv in PAIRS.items() for x in kv])
        i = F.col("doc_id")
        # days apart, so that look-backs and expiry part them
        ts = F.col("ts").cast("timestamp_ntz") - F.make_dt_interval((i % 40).cast("int"))
        located = i % 5 != 0
        title = F.split_part("text", F.lit("\n"), F.lit(1))
        day = F.date_format(ts, "yyyy-MM-dd")
        joined = d.join(e, d.doc_id == e.event_id).join(F.broadcast(n), n.n_nationkey == i % 25)  # nation has 25 rows
        return joined.select(
            i.alias("id"),
            F.element_at(F.array(*map(F.lit, ("gdelt", "telegram", "mastodon", "rss"))), (i % 4 + 1).cast("int")).alias("source"),
            F.concat(F.lit("id-"), i).alias("source_id"),
            times.epoch_seconds(ts).alias("collected_at"),
            F.when(i % 17 != 0, ts - F.make_dt_interval(F.lit(0), (i % 48).cast("int"))).alias("published_at"),
            title.alias("title"),
            F.col("text").alias("body"),
            F.when(located, (i * 37 % 18_000) / 100.0 - 90).cast("double").alias("lat"),
            F.when(located, (i * 91 % 36_000) / 100.0 - 180).cast("double").alias("lon"),
            F.col("n_name").alias("location_name"),
            F.concat(
                F.col("text"), F.lit(" https://"), d.source, F.lit(".example.com/a"), i, F.lit(" on "), day, F.lit(" up "), i % 100, F.lit("% in "),
                i % 9 + 1, F.lit(" days "), keyword[F.col("event_type")], F.lit(" 18,000"),
            ).alias("item_text"),
            ts.alias("ts"), "event_type",
        )

    @cached_property
    def raw_records(self) -> DataFrame:
        """Good rows, re-arrivals under a changed title, and rows of a bad source or latitude."""
        base = self.items.withColumn("arrival", F.col("id"))
        again = self.items.filter("id % 10 = 0").withColumns({"arrival": F.col("id") + 1_000_000, "title": F.concat(F.lit("again "), "title")})
        bad = self.items.filter("id % 23 = 0 OR id % 29 = 0").withColumns({
            "arrival": F.col("id") + 2_000_000,
            "source": F.when(F.col("id") % 23 == 0, "x").otherwise(F.col("source")),
            "lat": F.when(F.col("id") % 29 == 0, 95.0).otherwise(F.col("lat")),
            "lon": F.coalesce("lon", F.lit(0.0)),
        })
        return base.unionByName(again).unionByName(bad)

    @cached_property
    def existing_items(self) -> DataFrame:
        return self.items.filter("id % 3 = 0")

    @cached_property
    def clusters(self) -> DataFrame:
        """One for each place, source and kind of event, founded by its first item; the title is cut as the rule of founding says."""
        first = F.min_by(F.struct("item_text", "lat", "lon", "ts"), F.col("id"))
        return self.items.groupBy(*FOUNDED_BY).agg(F.min("id").alias("id"), first.alias("f")).select(
            F.concat(F.lit("c-"), "id").alias("cluster_id"), F.substring("f.item_text", 1, 200).alias("title"), "f.lat", "f.lon", "location_name",
            F.col("f.ts").alias("first_seen_at"), F.col("f.ts").alias("last_seen_at"),
        )

    @cached_property
    def assigned(self) -> DataFrame:
        founders = self.items.groupBy(*FOUNDED_BY).agg(F.min("id").alias("founder"))
        joined = self.items.join(founders, FOUNDED_BY).select(*self.items.columns, "founder")
        return joined.withColumn("cluster_id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("c-"), "founder"))).drop("founder")

    @cached_property
    def places(self) -> DataFrame:
        c, n = self.table("customer"), self.table("nation")
        towns = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
            F.col("c_custkey").cast("long").alias("geoname_id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"),
            F.lit("P").alias("feature_class"), F.lit("PPL").alias("feature_code"),
            F.greatest(F.lit(0), F.floor(F.col("c_acctbal") * 100)).cast("long").alias("population"),
        )
        nations = n.select(
            (F.col("n_nationkey") + 1_000_000).cast("long").alias("geoname_id"), F.col("n_name").alias("name"), F.col("n_name").alias("country"),
            F.lit("A").alias("feature_class"), F.lit("PCLI").alias("feature_code"), (1_000_000 * (F.col("n_nationkey") + 1)).cast("long").alias("population"),
        )
        # names of one token, which a query may mean as a country
        short = nations.withColumns({"geoname_id": F.col("geoname_id") + 1_000_000, "name": F.concat(F.lit("Land"), F.col("geoname_id") - 1_000_000)})
        g = F.col("geoname_id")
        return towns.unionByName(nations).unionByName(short).withColumns({
            "lat": ((g * 37 % 18_000) / 100.0 - 90).cast("double"), "lon": ((g * 91 % 36_000) / 100.0 - 180).cast("double"),
        })

    @cached_property
    def alt_names(self) -> DataFrame:
        known = self.places.filter("geoname_id % 4 = 0").select("geoname_id", F.concat(F.lower("name"), F.lit(" alt")).alias("alt_name"))
        return known.unionByName(known.select((F.col("geoname_id") + 5_000_000).alias("geoname_id"), "alt_name"))

    @cached_property
    def place_queries(self) -> DataFrame:
        n, c = self.table("nation"), self.table("customer")
        odd = self.spark.createDataFrame([("x",), ("Nowhere Land",)], "q string")
        named = n.select(F.col("n_name").alias("q")).union(c.select(F.upper("c_name"))).union(n.select(F.concat(F.lit(" "), "n_name", F.lit(" "))))
        return named.union(n.select(F.concat(F.lit("land"), "n_nationkey"))).union(odd)

    @cached_property
    def vessel_messages(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").cast("long").alias("mmsi"), "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("sog"),
            F.col("event_type").alias("message_type"), times.epoch_seconds(F.col("ts").cast("timestamp_ntz")).alias("seen"),
        )


#: The same tables for DuckDB; a query's SQL follows ``WITH`` and these.
SQL = f"""
items AS (SELECT d.doc_id AS id, CASE d.doc_id % 4 WHEN 0 THEN 'gdelt' WHEN 1 THEN 'telegram' WHEN 2 THEN 'mastodon' ELSE 'rss' END AS source,
  'id-' || d.doc_id AS source_id, CAST(floor(epoch(e.ts - to_days(CAST(d.doc_id % 40 AS INTEGER)))) AS BIGINT) AS collected_at,
  CASE WHEN d.doc_id % 17 <> 0 THEN e.ts - to_days(CAST(d.doc_id % 40 AS INTEGER)) - to_hours(CAST(d.doc_id % 48 AS INTEGER)) END AS published_at,
  split_part(d.text, chr(10), 1) AS title, d.text AS body,
  CASE WHEN d.doc_id % 5 <> 0 THEN CAST(d.doc_id * 37 % 18000 AS DOUBLE) / 100 - 90 END AS lat,
  CASE WHEN d.doc_id % 5 <> 0 THEN CAST(d.doc_id * 91 % 36000 AS DOUBLE) / 100 - 180 END AS lon,
  n.n_name AS location_name,
  d.text || ' https://' || d.source || '.example.com/a' || d.doc_id || ' on ' || strftime(e.ts - to_days(CAST(d.doc_id % 40 AS INTEGER)), '%Y-%m-%d')
    || ' up ' || (d.doc_id % 100) || '% in ' || (d.doc_id % 9 + 1) || ' days ' || CASE e.event_type WHEN 'signup' THEN 'protest' WHEN 'error' THEN 'blackout'
    WHEN 'click' THEN 'sanctions' WHEN 'view' THEN 'footage' WHEN 'purchase' THEN 'killed' END || ' 18,000' AS item_text, e.ts - to_days(CAST(d.doc_id % 40 AS INTEGER)) AS ts, e.event_type
  FROM documents d JOIN events e ON e.event_id = d.doc_id JOIN nation n ON n.n_nationkey = d.doc_id % 25),
raw_records AS (SELECT *, id AS arrival FROM items UNION ALL
  SELECT * REPLACE ('again ' || title AS title), id + 1000000 FROM items WHERE id % 10 = 0 UNION ALL
  SELECT * REPLACE (CASE WHEN id % 23 = 0 THEN 'x' ELSE source END AS source, CASE WHEN id % 29 = 0 THEN 95.0 ELSE lat END AS lat, coalesce(lon, 0.0) AS lon),
    id + 2000000 FROM items WHERE id % 23 = 0 OR id % 29 = 0),
existing_items AS (SELECT * FROM items WHERE id % 3 = 0),
clusters AS (SELECT 'c-' || id AS cluster_id, substring(item_text, 1, 200) AS title, lat, lon, location_name, ts AS first_seen_at, ts AS last_seen_at
  FROM items WHERE id IN (SELECT min(id) FROM items GROUP BY location_name, source, event_type)),
assigned AS (SELECT *, CASE WHEN id % 7 <> 0 THEN 'c-' || min(id) OVER (PARTITION BY location_name, source, event_type) END AS cluster_id FROM items),
places0 AS (SELECT CAST(c_custkey AS BIGINT) AS geoname_id, c_name AS name, n_name AS country, 'P' AS feature_class, 'PPL' AS feature_code,
  CAST(greatest(0, floor(c_acctbal * 100)) AS BIGINT) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
  SELECT 1000000 + n_nationkey, n_name, n_name, 'A', 'PCLI', 1000000 * (n_nationkey + 1) FROM nation UNION ALL
  SELECT 2000000 + n_nationkey, 'Land' || n_nationkey, n_name, 'A', 'PCLI', 1000000 * (n_nationkey + 1) FROM nation),
places AS (SELECT *, CAST(geoname_id * 37 % 18000 AS DOUBLE) / 100 - 90 AS lat, CAST(geoname_id * 91 % 36000 AS DOUBLE) / 100 - 180 AS lon FROM places0),
alt_names AS (SELECT geoname_id, lower(name) || ' alt' AS alt_name FROM places WHERE geoname_id % 4 = 0 UNION ALL
  SELECT geoname_id + 5000000, lower(name) || ' alt' FROM places WHERE geoname_id % 4 = 0),
place_queries AS (SELECT n_name AS q FROM nation UNION ALL SELECT upper(c_name) FROM customer UNION ALL SELECT ' ' || n_name || ' ' FROM nation
  UNION ALL SELECT 'land' || n_nationkey FROM nation UNION ALL SELECT 'x' UNION ALL SELECT 'Nowhere Land'),
vessel_messages AS (SELECT CAST(user_id AS BIGINT) AS mmsi, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS sog, event_type AS message_type,
  CAST(floor(epoch(ts)) AS BIGINT) AS seen FROM events)"""
