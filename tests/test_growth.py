"""Work that grows no faster than the input: tasks, plans and steps of the queries that a review found to grow."""

import json
from datetime import datetime
from types import SimpleNamespace

from pyspark.sql import functions as F

from tidemark import plans
from tidemark.functions import fuzzy, geo, ngrams, text
from tidemark.operators import cells, features, serve
from tidemark.plans import domain, landed
from tidemark.sources import connectors


def test_texts_are_dealt_by_their_number(spark):
    rows = spark.range(20_000).select("id", F.lit("protest in the city on 2024-01-03").alias("t"))
    assert text.dealt(rows, "id").rdd.getNumPartitions() == 10
    assert features.signature_arrays(rows, "id", "t").rdd.getNumPartitions() == 10
    assert ngrams.bucket_counts(rows, "id", "t").rdd.getNumPartitions() == 10
    assert text.dealt(rows.limit(5), "id").rdd.getNumPartitions() == 8


def test_words_are_cut_once_and_distinct_by_hash(spark):
    named = text.with_words(spark.createDataFrame([(1, "Killed, KILLED riots the ab killed longword")], "id long, t string"), "t")
    assert named.select("words", "hits").first() == (["killed", "riots", "longword"], ["death", "death", "violence", "death"])
    family = named.select(F.explode_outer(F.array(text.dominant_family(F.col("hits")))).alias("family")).filter("family IS NOT NULL")
    plan = family._jdf.queryExecution().optimizedPlan().toString()
    assert family.first()["family"] == "death" and plan.count("split(") == 1
    arrays = features.signature_arrays(spark.createDataFrame([(1, "3 days, 3 days, 18,000 and 18,000")], "id long, t string"), "id", "t")
    assert "array_distinct(concat(transform" not in arrays._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, arrays.first()["features"])) == [("NUM", "18000"), ("NUM", "3"), ("SEMANTIC", "000"), ("TW", "3d")]


def test_numbered_grams_equal_counted_strings(monkeypatch):
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))
    texts = ["", "a", "ab ab ab", "naïve 漢字 ünï 😀x", wide[:2500], wide, " ".join(wide[k : k + 9] for k in range(0, 3000, 7))]
    for limit in (ngrams.KEY_BITS, 40):
        monkeypatch.setattr(ngrams, "KEY_BITS", limit)
        got = [{} for _ in texts]
        for at, found in ngrams._counted(texts):
            for owner, gram, n, grams in found:
                for o, g, k in zip((owner + at).tolist(), gram.tolist(), n.tolist()):
                    assert grams[g] not in got[o]
                    got[o][grams[g]] = k
        assert got == [dict(ngrams.grams_of(t)) for t in texts]
        for t, (buckets, n) in zip(texts, ngrams._vectors(texts, {})):
            wanted = {}
            for g, k in ngrams.grams_of(t).items():
                wanted[ngrams.bucket_of(g)] = wanted.get(ngrams.bucket_of(g), 0) + k
            assert dict(zip(buckets.tolist(), n.tolist())) == wanted and sorted(wanted) == buckets.tolist()


def test_items_of_a_cluster_are_in_order_within_a_second(spark):
    rows = [(1, 200), (2, 900), (3, None), (4, 900), (5, 100)]
    items = spark.createDataFrame([(i, "c", None if m is None else datetime(2024, 1, 1, 0, 0, 7, m)) for i, m in rows], "id long, cluster_id string, published_at timestamp_ntz")
    items = items.select("*", *[F.lit(None).cast("string").alias(c) for c in ("source", "source_id", "title", "location_name")], F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    clusters = spark.createDataFrame([("c",)], "cluster_id string")
    assert [x["id"] for x in serve.clusters_since(clusters, items, limit=None).first()["items"]] == [3, 2, 4, 1, 5]


def test_references_without_an_end_are_text():
    page = "<title>a&amp</title><p>b &copy; &ampc &notit; &&&lt; &#65; &#x42; &#66 c&</p>"
    assert fuzzy.html_text(page) == "a&ampb © &ampc &notit; &&< A B &#66 c&"
    assert fuzzy.html_text(page, " ") == "a&amp b © &ampc &notit; &&< A B &#66 c&"


def test_blank_paragraphs_and_spaces_of_unicode_are_kept(spark):
    bodies = ["", "  \n", "\u00a0a b\u3000", "\x0ba\x85", " \t<p></p> & b\r\n", None]
    items = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    found = {r["id"]: (r["text"], r["title"]) for r in domain.mastodon_records(SimpleNamespace(items=items)).collect()}
    wanted = [" #tag", " #tag", "\u00a0a b\u3000 #tag", "\x0ba\x85 #tag", "<p></p> & b #tag", None]
    assert [found[k] for k in range(len(bodies))] == [(w, w) for w in wanted]
    page = "<p> </p><b>a</b> <script>x</script><p><i></i>c</p>"
    assert fuzzy.html_text(page, " ") == "a c" and fuzzy.html_text(page, " ", blanks=True) == " a  c" and fuzzy.html_text(page) == "a c"


def test_versions_hold_all_recent_clusters(spark):
    """More clusters than an index for matching may have."""
    clusters = spark.range(6000).select(F.concat(F.lit("c"), "id").alias("cluster_id"), F.lit("t").alias("title"), F.lit(datetime(2024, 1, 3)).cast("timestamp_ntz").alias("last_seen_at"))
    t = SimpleNamespace(spark=spark, clusters=clusters, as_of=F.lit("2024-01-04 00:30:00").cast("timestamp_ntz"))
    assert {r["n"] for r in landed.index_versions(t).collect()} == {6000}


def test_versions_without_entries_have_a_time(spark):
    """No cluster is recent where a larger table's first events, which found them all, are older."""
    clusters = spark.range(60).select(F.concat(F.lit("c"), "id").alias("cluster_id"), F.lit("t").alias("title"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("last_seen_at"))
    t = SimpleNamespace(spark=spark, clusters=clusters, as_of=F.lit("2024-01-04 00:30:00").cast("timestamp_ntz"))
    wanted = [(0, 0, 0), (200, 0, 0), (300, 0, 0), (301, 301, 0), (500, 301, 0), (700, 700, 0)]
    assert sorted((r["asked"], r["made"], r["n"]) for r in landed.index_versions(t).collect()) == wanted


def test_token_sets_of_all_items_meet_their_texts(spark, sf_dir):
    found = plans.QUERIES["STR-25"](spark, sf_dir)
    assert found.filter("id % 3 = 0 AND score = 100").count() > 0 and found.select("mixed").distinct().count() > 5


def test_a_trigger_takes_many_batches(spark, tmp_path):
    names, home = [f"{k}.json" for k in range(30)], tmp_path / "home"
    for k, name in enumerate(names):
        (tmp_path / name).write_text(json.dumps({"articles": [{"url": f"u{k * 30 + i}"} for i in range(30)]}))
    (tmp_path / connectors.MANIFEST).write_text("".join(json.dumps({"file": n, "entries": 30, "fetched_at": 1}) + "\n" for n in names))
    triggers = []

    def sink(rows, number):
        triggers.append(number)
        rows.write.mode("overwrite").parquet(f"{home}/rows/of={number}")

    asked = connectors.stream(spark, "gdelt", str(tmp_path), f"{home}/progress.json", 70, 9).writeStream.foreachBatch(sink).option("checkpointLocation", f"{home}/checkpoint").start()
    asked.processAllAvailable()
    asked.stop()
    found = spark.read.parquet(f"{home}/rows").select("of", "batch", F.get_json_object("value", "$.source_id").alias("u")).collect()
    assert len(triggers) == 2 and sorted((r["u"], r["batch"], r["of"]) for r in found) == sorted((f"u{i}", i // 70, i // 630) for i in range(900))


def test_pairs_by_place_are_dealt_by_their_number(spark, monkeypatch):
    points = spark.range(400).select("id", (F.col("id") % 4 / 1000).cast("double").alias("lat"), F.when(F.col("id") % 9 > 0, 10.0).alias("lon")).coalesce(1)
    centres = spark.range(60).select(F.col("id").alias("centre"), F.lit(0.0).alias("centre_lat"), F.lit(10.0).alias("centre_lon"), (F.col("id") % 3 / 9).cast("double").alias("radius_km"))
    key = lambda found: sorted((r["id"], r["centre"]) for r in found.select("id", "centre").collect())
    wanted = [(i, c) for i in range(400) if i % 9 for c in range(60) if i % 4 * 0.1112 <= c % 3 / 9]
    whole = cells.within_radius(points, centres)
    monkeypatch.setattr(cells, "PAIRS", 500)
    cut = cells.within_radius(points, centres)
    assert key(whole) == key(cut) == wanted
    assert whole.rdd.getNumPartitions() == 8 and cut.rdd.getNumPartitions() >= 40
    assert cut.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < len(wanted) / 8
    assert key(cells.within_radius(points.limit(0), centres)) == []


def test_crowded_cells_do_not_repeat_their_larger_side(spark, monkeypatch):
    """20 points and 2,000 circles of one cell, 80 tasks' worth of pairs: each circle once, not once for each slice of the points."""
    points = spark.range(20).select("id", (F.col("id") / 1000).cast("double").alias("lat"), F.lit(11.0).alias("lon"))
    centres = spark.range(2000).select(F.col("id").alias("centre"), F.lit(0.5).alias("centre_lat"), (11 + F.col("id") / 10_000).alias("centre_lon"), F.lit(57.0).alias("radius_km"))
    key = lambda found: sorted((r["id"], r["centre"]) for r in found.select("id", "centre").collect())
    wanted = key(cells.within_radius(points, centres))
    monkeypatch.setattr(cells, "PAIRS", 500)
    dealt, real = [], cells._dealt
    monkeypatch.setattr(cells, "_dealt", lambda *a: dealt.append(real(*a)) or dealt[-1])
    assert key(cells.within_radius(points, centres)) == wanted and 0 < len(wanted) < 40_000
    placed, spread = (side.count() for side in dealt[0])
    assert placed == 20 * 80 and spread <= 2 * 2000 and dealt[0][1].rdd.getNumPartitions() >= 80


def test_centres_of_one_circle_are_measured_once(spark, monkeypatch):
    rows = [(k if k % 5 else None, "a" if k % 2 else None, 0.0, 10.0 + k % 2, 50.0) for k in range(300)] + [(7, "a", 0.0, 11.0, 50.0)] * 3
    centres = spark.createDataFrame(rows, "centre long, tag string, centre_lat double, centre_lon double, radius_km double")
    points = spark.createDataFrame([(1, 0.1, 10.0), (2, 0.1, 11.0), (3, 5.0, 10.0)], "id long, lat double, lon double")
    circle, others = ["centre_lat", "centre_lon", "radius_km"], ["centre", "tag"]
    wanted = sorted((str(r[:2]), 1 + r[3] - 10.0) for r in rows)
    for most, least_rows in ((1024, 2), (20, 12)):
        monkeypatch.setattr(cells, "MEMBERS", most)
        held = [len(r["_members"]) for r in cells._circles(centres, circle, others).collect()]
        assert sum(held) == 303 and least_rows <= len(held) <= 16 and (most > 303 or max(held) < 100)
        found = cells.within_radius(points, centres, digits=3)
        assert found.columns == ["id", "lat", "lon", *centres.columns, "distance_km"] and {r["distance_km"] for r in found.collect()} == {11.119}
        assert sorted((str((r["centre"], r["tag"])), float(r["id"])) for r in found.collect()) == wanted
    assert cells.within_radius(points, centres.select(circle)).count() == 303


def test_distances_are_rounded_as_sql_rounds_doubles(spark):
    import duckdb

    values = [0.0, 0.0004999, 0.0005, 1.0005, 1.0015, 2.6745, 749.9995, 749.99949999, 20015.0865, 0.1 + 0.2, 1 / 3]
    found = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", geo.rounded(F.col("v"), 3).alias("r")).collect()
    assert [r["r"] for r in sorted(found)] == [duckdb.execute("SELECT round(?::DOUBLE, 3)", [v]).fetchone()[0] for v in values]


def test_buckets_are_hashed_once_in_a_worker(monkeypatch):
    hashed, real = [], ngrams.bucket_of
    monkeypatch.setattr(ngrams, "bucket_of", lambda g: hashed.append(g) or real(g))
    first, again = ngrams._vectors(["hashed once only"]), ngrams._vectors(["hashed once only"])
    assert len(hashed) == len(set(hashed)) and all((a == b).all() for a, b in zip(first[0], again[0]))
    monkeypatch.setattr(ngrams, "KNOWN", 0)
    assert all((a == b).all() for a, b in zip(first[0], ngrams._vectors(["hashed once only"])[0]))
