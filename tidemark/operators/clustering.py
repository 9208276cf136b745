"""The clustering cycle: match items with the index, found clusters, store, clean up, recount.

It gives what taking the items one by one would, newest first: an item joins
the best entry that accepts it, be it a cluster of the index or one founded
earlier in the same cycle, or else founds a cluster.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import cluster, features, serve, similarity

#: Items of a cycle; more wait for the next one.
PER_CYCLE = 10_000


def assign_batch(
    items: DataFrame, index: DataFrame, rules: similarity.Rules = similarity.Rules(), entities: features.EntityExtractor | None = None,
    lexical: bool = True, most: int = PER_CYCLE,
) -> DataFrame:
    """``(id, cluster_id, founder, score, reason)`` of the ``most`` newest items.

    ``items``: id, source, source_id, text, created_at, collected_at; ``index``:
    pos, cluster_id, text, last_seen_at. A founder's cluster id is made of its
    key, so a rerun gives the same; its text is cut at 200 characters, as a
    cluster's title is. Of equal scores the newest cluster wins, and clusters
    founded in the cycle are newer than those of the index. An item that shares
    no feature with any entry or item of the batch meets all of them.
    """
    taken = items.orderBy(F.desc("collected_at"), "id").limit(most)
    turn = F.row_number().over(Window.orderBy(F.desc("collected_at"), "id")).cast("long")  # of at most ``most`` rows
    batch = cluster.cut(taken.withColumn("turn", turn))
    ask = batch.select(F.col("turn").alias("id"), "text", "created_at")
    # every item is an entry, too, that later ones may meet; newer entries come first
    as_entries = batch.select((-F.col("turn")).alias("pos"), F.substring("text", 1, 200).alias("text"), F.col("created_at").alias("last_seen_at"))
    whole = replace(rules, max_candidates=similarity.MAX_ENTRIES)
    found = similarity.accepted(ask, index.select("pos", "text", "last_seen_at").unionByName(as_entries), whole, lexical, entities, earlier=True)
    found = cluster.cut(found)

    accepts = found.filter("pos < 0").select((-F.col("pos")).alias("earlier"), F.col("id").alias("later"))
    led = cluster.leaders(ask.select("id"), accepts, found.filter("pos > 0").select("id").distinct())
    heads = led.filter("leader").select((-F.col("id")).alias("pos"))
    usable = found.filter("pos > 0").unionByName(found.join(heads, "pos", "left_semi")).join(led.filter("NOT leader"), "id", "left_semi")
    best = similarity.first_stage_best(usable)

    new_id = text.record_hash(F.col("source"), F.col("source_id"))
    names = index.select("pos", "cluster_id").unionByName(batch.select((-F.col("turn")).alias("pos"), new_id.alias("cluster_id")))
    founded = led.filter("leader").select("id", (-F.col("id")).alias("pos"), F.lit(None).cast("double").alias("score"), F.lit("new_cluster").alias("reason"))
    chosen = best.unionByName(founded, allowMissingColumns=True).join(names, "pos")
    turns = batch.select(F.col("id").alias("item"), F.col("turn").alias("id"))
    return chosen.join(turns, "id").select(F.col("item").alias("id"), "cluster_id", (F.col("reason") == "new_cluster").alias("founder"), "score", "reason")


def cycle(
    items: DataFrame, clusters: DataFrame, as_of: Column, rules: similarity.Rules = similarity.Rules(), entities: features.EntityExtractor | None = None,
    lexical: bool = True, days: int = 7,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(items, clusters, totals)`` after one cycle over the items without a cluster.

    Assigned clusters are last seen at ``as_of``; clusters not seen for ``days``
    go and free their items; counts, places and names are those of the members.
    """
    waiting = items.filter("cluster_id IS NULL").select("id", "source", "source_id", F.col("item_text").alias("text"), serve.event_time().alias("created_at"), "collected_at")
    given = cluster.cut(assign_batch(waiting, similarity.index_of(clusters, as_of), rules, entities, lexical))
    chosen = given.select("id", F.col("cluster_id").alias("_given"))
    placed = items.join(chosen, "id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "_given")).drop("_given")
    founders = items.join(given.filter("founder").select("id"), "id", "left_semi")
    founded = serve.found_clusters(founders, as_of).select("cluster_id", "title", "lat", "lon", "location_name", "first_seen_at", "last_seen_at")
    touched = given.select("cluster_id").distinct().withColumn("_touched", F.lit(True))
    every = clusters.select(founded.columns).unionByName(founded).join(touched, "cluster_id", "left")
    every = cluster.cut(every.withColumn("last_seen_at", F.when(F.col("_touched"), as_of).otherwise(F.col("last_seen_at"))).drop("_touched"))
    alive, kept = serve.expire(every, placed, as_of, days)
    kept = cluster.cut(kept)
    stats = serve.located_stats(kept).select("cluster_id", "item_count", *[F.col(c).alias(f"_{c}") for c in ("lat", "lon", "location_name")])
    counted = alive.join(stats, "cluster_id", "left").withColumns({
        "item_count": F.coalesce("item_count", F.lit(0)), **{c: F.coalesce(f"_{c}", c) for c in ("lat", "lon", "location_name")},
    }).drop("_lat", "_lon", "_location_name")
    totals = given.agg(F.count("*").alias("processed"), F.count_if("founder").alias("new_clusters"), F.count_if(~F.col("founder")).alias("clustered"))
    return kept, counted, totals
