"""Landed payloads and live streams: files that are odd, streams that restart, clocks that are given."""

import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fuzzy, geo, times
from tidemark.operators import cells, live
from tidemark.sources import connectors, hazards, xml_feeds, zipped
from tidemark.streaming import vessels, versions


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_zip_ranges_give_each_line_once(spark, tmp_path, size):
    text = "".join(f"{i}\tname é {'x' * (i % 40)}\n" for i in range(200)) + "\r\n\nlast without end"
    want = sorted(x.removesuffix("\r") for x in text.split("\n"))
    for kind, name in ((zipfile.ZIP_STORED, "a"), (zipfile.ZIP_DEFLATED, "b")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", kind) as z:
            z.writestr("other.txt", "no\n" * 50)
            z.writestr("m.txt", text)
            z.writestr("empty.txt", "")
        got = zipped.member_lines(spark, str(tmp_path / f"{name}.zip"), "m.txt", size)
        assert sorted(r[0] for r in got.collect()) == want
        assert zipped.member_lines(spark, str(tmp_path / f"{name}.zip"), "empty.txt", size).count() == 0
        with pytest.raises(Exception, match="nothing.txt"):
            zipped.member_lines(spark, str(tmp_path / f"{name}.zip"), "nothing.txt", size).count()
    if size == 100:
        plain = tmp_path / "plain.txt"
        plain.write_text(text)
        assert sorted(r[0] for r in zipped.member_lines(spark, str(tmp_path), "m.txt", size).collect()) == sorted(2 * want)
        assert sorted(r[0] for r in spark.read.text(str(plain)).collect()) == want


def test_feeds_of_three_kinds_and_broken_ones(spark, tmp_path):
    rss = "<?xml version='1.0'?><rss><channel><title>A &amp; B</title>" + "".join(f"<item><title>t{i}</title><link>l{i}</link><pubDate>Wed, 3 Jan 2024 10:00 +0130</pubDate></item>" for i in range(5)) + "</channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><title/><entry><title>x</title><link rel='self' href='no'/><link href='yes'/><content>c</content><published>2024-01-03T10:00:00Z</published><updated>2025-01-01T00:00:00Z</updated></entry></feed>"
    rdf = "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>R</title></channel><item><title>x</title><link>l</link><dc:date>2024-01-03T10:00:00+02:00</dc:date></item></rdf:RDF>"
    for name, content in (("rss", rss), ("atom", atom), ("rdf", rdf), ("none", "<rss><channel><title>empty</title></channel></rss>"), ("bad", "<rss><channel><item><title>y</item></channel></rss>"), ("text", "not xml"), ("blank", "")):
        (tmp_path / f"{name}.xml").write_text(content)
    got = {(r["file"], r["position"]): r for r in xml_feeds.feed_items(spark, str(tmp_path), most=3).collect()}
    assert sorted(got) == [("atom.xml", 0), ("rdf.xml", 0), ("rss.xml", 0), ("rss.xml", 1), ("rss.xml", 2)]
    a, r = got["atom.xml", 0], got["rss.xml", 1]
    assert (a["author"], a["link"], a["summary"], a["published"]) == ("Unknown", "yes", "c", "2024-01-03T10:00:00Z")
    assert (r["author"], r["title"], r["link"], r["published"]) == ("A & B", "t1", "l1", "2024-01-03T08:30:00Z")
    assert (got["rdf.xml", 0]["author"], got["rdf.xml", 0]["link"], got["rdf.xml", 0]["published"]) == ("R", "l", "2024-01-03T08:00:00Z")
    assert sorted(r["file"] for r in xml_feeds.broken_feeds(spark, str(tmp_path)).collect()) == ["bad.xml", "text.xml"]


def test_times_of_feeds_and_bounds(spark):
    mail = {"Wed, 03 Jan 2024 10:00:00 GMT": "2024-01-03T10:00:00Z", " 3 Jan 2024 10:00 -0230 ": "2024-01-03T12:30:00Z", "03 Foo 2024 10:00:00 GMT": None, "": None, "2024-01-03": None, None: None}
    rows = spark.createDataFrame([(k,) for k in mail], "t string").select("t", times.iso_text(times.parse_rfc822(F.col("t"))).alias("iso")).collect()
    assert {r["t"]: r["iso"] for r in rows} == mail
    now = datetime(2024, 1, 10)
    asked = ["24h", " 7D ", "0h", "h", "-3h", "2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "soon", "", None]
    got = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, t string").select("i", times.since_bound(F.col("t"), F.lit(now).cast("timestamp_ntz")).alias("b")).collect()
    assert {r["i"]: r["b"] for r in got} == {i: times.since(a, now) for i, a in enumerate(asked)}
    boxes = [(-180.0, -90.0, 180.0, 90.0), (0.0, 0.0, 0.0, 1.0), (-181.0, 0.0, 1.0, 1.0), (0.0, 5.0, 1.0, 4.0), (0.0, 0.0, 1.0, 91.0), (None, 0.0, 1.0, 1.0)]
    for r in spark.createDataFrame(boxes, "a double, b double, c double, d double").select("*", geo.box_fault(*map(F.col, "abcd")).alias("fault")).collect():
        try:
            geo.check_box(tuple(r)[:4])
            said = None
        except (ValueError, TypeError) as bad:
            said = str(bad)
        assert (r["fault"] is None) == (said is None) and (r["a"] is None or r["fault"] == said)
    assert fuzzy.normal_text(" ＡＢ１  Straße ΣΑΣ ") == "ab1 strasse σασ"


def test_radius_join_equals_all_pairs(spark):
    points = [(i, lat, lon) for i, (lat, lon) in enumerate((a, b) for a in (-90.0, -89.5, -45.3, -0.01, 0.0, 12.0, 60.5, 89.9, 90.0) for b in (-180.0, -179.9, -90.0, 0.0, 0.5, 90.0, 179.95, 180.0))]
    centres = [(j, lat, lon, r) for j, (lat, lon, r) in enumerate([(0.0, 180.0, 120.0), (0.0, -179.99, 0.0), (89.8, 10.0, 500.0), (-90.0, 0.0, 60.0), (60.0, 0.0, 3000.0), (10.0, 170.0, 2500.0), (5.0, 5.0, 20015.1), (1.0, 1.0, 30000.0), (0.0, 0.0, 0.0)])]
    p = spark.createDataFrame([*points, (999, None, 1.0), (998, 1.0, None)], "i int, lat double, lon double")
    c = spark.createDataFrame([*centres, (99, None, 0.0, 1.0), (98, 0.0, 0.0, None)], "j int, centre_lat double, centre_lon double, radius_km double")
    all_pairs = p.crossJoin(c).filter(geo.haversine_km(*map(F.col, ("lat", "lon", "centre_lat", "centre_lon"))) <= F.col("radius_km"))
    for size in (2.0, 0.5, 90.0):
        met = cells.within_radius(p, c, size)
        assert sorted((r["i"], r["j"]) for r in met.collect()) == sorted((r["i"], r["j"]) for r in all_pairs.collect())
    plan = cells.within_radius(p, c)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def messages(rows):
    return "\n".join(json.dumps({"snapshot": s, "mmsi": m, "at": f"2024-01-01T00:{t // 60:02}:{t % 60:02}.000Z", "event_id": e, "message_type": k, "sog": v}) for e, (s, m, t, k, v) in enumerate(rows))


SCHEMA = "snapshot string, mmsi long, at timestamp, event_id long, message_type string, sog double"
RULE = vessels.StopRule(least=10, stable=20, hard=100)
#: s1 ends early: no new vessel for 20 s; s2 hears of a new vessel every 15 s and ends at the hard bound.
PARTS = [
    [("s1", 1, 0, "a", 1.0), ("s1", 2, 5, "b", None), ("s2", 10, 0, "a", 2.0), ("s2", 11, 14, "a", None), ("s1", 1, 9, "c", None)],
    [("s1", 1, 24, "d", 3.0), ("s2", 12, 24, "a", 1.0), ("s2", 13, 38, "a", 1.0)],
    [("s1", 1, 25, "late", 9.0), ("s1", 3, 40, "late", 9.0), *[("s2", 20 + k, 40 + 14 * k, "x", float(k)) for k in range(7)], ("s2", 10, 99, "y", 7.0)],
    [("s3", 1, 400, "a", 1.0), ("s1", 4, 401, "late", 1.0)],
]


def test_vessel_stream_ends_snapshots_and_restarts(spark, tmp_path):
    landing, home = tmp_path / "in", tmp_path / "home"
    landing.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", vessels.ROCKSDB)
    try:
        for k, part in enumerate(PARTS):  # a new query for each, from the checkpoint
            (landing / f"{k}.json").write_text(messages(part))
            stream = spark.readStream.schema(SCHEMA).json(str(landing))
            ended = vessels.snapshot_stream(stream, RULE)
            ended.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    at_rest = spark.read.schema(SCHEMA).json(str(landing)).filter("snapshot <> 's3'")
    columns = ["snapshot", "mmsi", "first_seen", "last_seen", "last_message_type", "sog", "messages"]
    wanted = sorted(map(tuple, vessels.snapshots(at_rest, RULE).select(columns).collect()))
    got = sorted(map(tuple, spark.read.parquet(f"{home}/out").select(columns).collect()))
    assert got == wanted and {r[0] for r in got} == {"s1", "s2"}
    assert [r[:2] + r[4:6] for r in got if r[0] == "s1"] == [("s1", 1, "d", 3.0), ("s1", 2, "b", None)]  # 24 s is before its end at 25 s
    assert ("s2", 10, "y", 7.0) in [r[:2] + r[4:6] for r in got]
    ends = {r["snapshot"]: (r["ends"] - r["started"]).total_seconds() for r in vessels.snapshot_ends(at_rest, RULE).collect()}
    assert ends == {"s1": 25.0, "s2": 100.0}


def test_stop_rule_of_a_timeout():
    least, stable = live.stop_rule(10.0)
    assert vessels.StopRule(least, stable, 10.0) == vessels.StopRule(5.0, 2.0, 10.0)


def test_connector_streams_take_250_and_restart(spark, tmp_path):
    for name, kind, make in (
        ("rss", "xml", lambda a, b: "<rss><channel>" + "".join(f"<item><title>t{i}</title><link>{'' if i == 7 else f'u{i}'}</link></item>" for i in range(a, b)) + "</channel></rss>"),
        ("gdelt", "json", lambda a, b: json.dumps({"articles": [{"url": None if i == 7 else f"u{i}", "title": "t"} for i in range(a, b)]})),
    ):
        folder, home = tmp_path / name, tmp_path / f"{name}-home"
        folder.mkdir()
        sizes = []

        def land(number, a, b):
            (folder / f"{number}.{kind}").write_text(make(a, b))
            with (folder / connectors.MANIFEST).open("a") as f:
                f.write(json.dumps({"file": f"{number}.{kind}", "entries": b - a, "fetched_at": 1000 + number}) + "\n")

        def go():
            sink = lambda batch, n: (sizes.append(batch.count()), batch.write.mode("overwrite").parquet(f"{home}/rows/of={n}"))
            asked = connectors.stream(spark, name, str(folder), f"{home}/progress.json").writeStream.foreachBatch(sink).option("checkpointLocation", f"{home}/checkpoint").trigger(processingTime="0 seconds").start()
            asked.processAllAvailable()
            asked.stop()

        land(0, 0, 120)
        land(1, 120, 700)
        go()
        assert [s for s in sizes if s] == [250, 250, 200]
        land(2, 700, 705)
        go()
        assert [s for s in sizes if s] == [250, 250, 200, 5]
        good, dead = connectors.split(spark.read.parquet(f"{home}/rows"))
        found = [json.loads(r["value"]) for r in good.collect()]
        assert sorted(r["source_id"] for r in found) == sorted(f"u{i}" for i in range(705) if i != 7) and {r["source"] for r in found} == {name}
        assert {r["collected_at"] for r in found} == {1000, 1001, 1002} and [r["connector"] for r in dead.collect()] == [name]
    with pytest.raises(ValueError, match="no connector"):
        connectors.stream(spark, "other", str(tmp_path), "x")


def test_a_quake_counts_once(spark, tmp_path):
    landing, out = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    quake = lambda i, day, updated: {"type": "Feature", "id": f"us{i}", "geometry": {"coordinates": [1.0, 2.0, 3]}, "properties": {"time": 86_400_000 * day, "updated": updated, "mag": i + updated / 10}}
    windows = [[quake(1, 10, 1), quake(2, 10, 1)], [quake(1, 10, 2), quake(3, 11, 1)], [quake(1, 10, 3), quake(2, 10, 1), quake(3, 11, 2), quake(4, 16, 1)]]
    for k, features in enumerate([*windows, []]):
        (landing / f"{k}.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}) if features else "oops")
        landed = spark.readStream.option("wholetext", True).text(str(landing)).withColumnRenamed("value", "payload")
        hazards.new_quakes(hazards.quakes(landed)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["quake_id"] for r in spark.read.parquet(str(out)).collect()) == ["us1", "us2", "us3", "us4"]
    at_rest = hazards.latest_quakes(hazards.quakes(spark.read.text(str(landing), wholetext=True).withColumnRenamed("value", "payload")))
    assert {r["quake_id"]: r["magnitude"] for r in at_rest.collect()} == {"us1": 1.3, "us2": 2.1, "us3": 3.2, "us4": 4.1}
    asked = spark.createDataFrame([("all_day",), ("all_month",), (None,)], "f string").select(hazards.quake_feed(F.col("f")).alias("q")).collect()
    assert [r["q"] for r in asked] == ["all_day", "all_week", "all_week"]


def test_a_changed_subscription_acts_from_the_next_batch(spark, tmp_path):
    landing, wanted = tmp_path / "in", str(tmp_path / "subscriptions")
    landing.mkdir()
    got = []
    box = lambda *types: [("s", -10.0, -10.0, 10.0, 10.0, None, list(types) or None), ("s", 5.0, 5.0, 20.0, 20.0, [2], None)]
    schema = "subscription string, min_lat double, min_lon double, max_lat double, max_lon double, vessels array<long>, types array<string>"

    def sink(batch, _):
        now = spark.read.schema(schema).parquet(wanted)
        got.append(sorted((r["mmsi"], r["lat"]) for r in live.subscribed(batch, now).collect()))

    for k, types in enumerate(([], ["b"])):
        spark.createDataFrame(box(*types), schema).write.mode("overwrite").parquet(wanted)
        rows = [{"mmsi": 1, "message_type": "a", "lat": 0.0, "lon": 0.0}, {"mmsi": 2, "message_type": "a", "lat": 7.0, "lon": 7.0}, {"mmsi": 3, "message_type": "b", "lat": 10.0, "lon": -10.0}, {"mmsi": 4, "message_type": "b", "lat": 15.0, "lon": 15.0}]
        (landing / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema("mmsi long, message_type string, lat double, lon double").json(str(landing))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert got == [[(1, 0.0), (2, 7.0), (3, 10.0)], [(2, 7.0), (3, 10.0)]]


def test_index_versions_are_refreshed_when_stale(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.createDataFrame([(len(made),)], "n int")

    store, start = versions.IndexVersions(spark, f"file://{tmp_path}/index"), datetime(2024, 1, 1)
    at = lambda seconds: store.current(start + timedelta(seconds=seconds), build).first()["n"]
    assert store.stale(start) and [at(s) for s in (0, 300, 301, 301, 600)] == [1, 1, 2, 2, 2]
    (tmp_path / "index" / f"version={int(start.timestamp()) + 650}").mkdir()  # a write that broke off
    again = versions.IndexVersions(spark, f"file://{tmp_path}/index")
    assert again.newest() == start + timedelta(seconds=301) and again.current(start + timedelta(seconds=602), build).first()["n"] == 3
    assert again.read(start).first()["n"] == 1  # versions do not change
