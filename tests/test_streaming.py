import json

from tidemark.streaming import jobs


def record(i, **more):
    return json.dumps({"source": "rss", "source_id": f"u{i}", "collected_at": 1_704_067_200 + i, "published_at": "2024-01-01T00:00:00Z", "lat": 1.0, "lon": 2.0, **more})


def counted(spark, home, batch):
    return {r["disposition"]: r["count"] for r in spark.read.parquet(f"{home}/counts/batch={batch}").collect()}


def test_stream_stores_inserted_records_and_counts_all(spark, tmp_path):
    landing, home = tmp_path / "in", tmp_path / "home"
    landing.mkdir()
    lines = [record(1), record(2), record(1), "not json", record(3, source="nowhere"), record(5, lat=None), record(6, published_at=None), record(7, published_at="soon"), record(8, source="mastodon", source_id="emsc8"), record(9, lat=95.0)]
    (landing / "a.json").write_text("\n".join(lines))
    jobs.ingest_stream(spark, str(landing), str(home), every=None).awaitTermination()
    assert counted(spark, home, 0) == {"INSERTED": 2, "DUPLICATE": 1, "INVALID": 2, "NO_LOCATION": 1, "MISSING_PUBLISHED_AT": 1, "INVALID_PUBLISHED_AT": 1, "IGNORED": 1}
    # 5 and 6 come again whole: they are new; 2 is not
    later = [record(2), record(4), record(5), record(6)]
    (landing / "b.json").write_text("\n".join(later))
    jobs.ingest_stream(spark, str(landing), str(home), every=None).awaitTermination()
    stored = spark.read.parquet(f"{home}/items")
    assert sorted(r["source_id"] for r in stored.collect()) == ["u1", "u2", "u4", "u5", "u6"]
    assert spark.read.text(f"{home}/dead").count() == 1 and counted(spark, home, 1) == {"INSERTED": 3, "DUPLICATE": 1}
    # a batch that runs again changes nothing
    again = spark.createDataFrame([(line,) for line in later], "value string")
    jobs.store_batch(again, 1, f"{home}/items", f"{home}/dead", f"{home}/counts")
    assert spark.read.parquet(f"{home}/items").count() == 5 and counted(spark, home, 1) == {"INSERTED": 3, "DUPLICATE": 1}


def test_clustering_stream_sees_each_record_once(spark, tmp_path):
    landing, home = tmp_path / "in", tmp_path / "home"
    landing.mkdir()
    seen = []
    work = lambda items, batch: seen.append(sorted(r["source_id"] for r in items.select("source_id").collect()))
    for name, ids in (("a", (1, 2)), ("b", (2, 3))):
        (landing / f"{name}.json").write_text("\n".join(map(record, ids)))
        jobs.ingest_stream(spark, str(landing), str(home), every=None).awaitTermination()
        jobs.cluster_stream(spark, str(home), work, every=None).awaitTermination()
    assert seen == [["u1", "u2"], ["u3"]]
