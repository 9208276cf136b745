"""Matching and clustering against one-by-one versions, and labelled texts of our own."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests import plain
from tidemark.functions import fuzzy, text
from tidemark.operators import clustering, lexical, similarity

START = datetime(2024, 1, 10)
TOPICS = {
    "dam": "Flood water breaks the Kelmar dam near Ostby, thousands leave homes on 2024-01-0{d}",
    "vote": "Parliament of Velden votes on the pension law after a long protest, unions say, {d} days of strikes",
    "port": "Fire at the harbour of Saltmere destroys two fuel tanks, police killed no rumours, 12,00{d} litres lost",
}
TAILS = ["", " according to the mayor", " - live updates", ", officials said today", " (video footage)"]
NOISE = [
    "Recipe for plum cake with almonds", "Chess club opens new season", "Local team wins by a goal in extra time", "Weather stays mild until Sunday",
    "Old violin found in attic sold", "Гроза прошла над городом без следа", "Νέο βιβλίο για παιδιά", "Museum shows glass from the north",
]


def labelled():
    rows = [(k * 10 + i, name, template.format(d=3) + tail) for k, (name, template) in enumerate(TOPICS.items()) for i, tail in enumerate(TAILS)]
    return rows + [(100 + i, None, t) for i, t in enumerate(NOISE)]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, "rss", f"u{i}", t, START + timedelta(hours=i % 7), 1_704_800_000 + i) for i, _, t in labelled()]
    items = spark.createDataFrame(rows, "id long, source string, source_id string, text string, created_at timestamp_ntz, collected_at long")
    index = spark.createDataFrame([(k + 1, f"c-{name}", template.format(d=3), START) for k, (name, template) in enumerate(TOPICS.items())], "pos long, cluster_id string, text string, last_seen_at timestamp_ntz")
    return items, index


def test_labelled_items_find_their_clusters(frames):
    items, index = frames
    names = {k + 1: name for k, name in enumerate(TOPICS)}
    got = {r["id"]: names[r["pos"]] for r in similarity.assign(items, index).collect()}
    assert got == {i: name for i, name, _ in labelled() if name}


def test_assignments_equal_a_plain_version(frames):
    items, index = frames
    wanted = plain.matched(
        {r["id"]: r["c"] for r in items.select("id", text.canonical(F.col("text")).alias("c")).collect()},
        {r["pos"]: r["c"] for r in index.select("pos", text.canonical(F.col("text")).alias("c")).collect()},
        {(r["id"], r["pos"]): r["score"] for r in similarity.semantic_matches(items, index).collect()},
        {(i, p) for i, _, _ in labelled() for p in (1, 2, 3)},
    )
    got = {r["id"]: (r["pos"], r["score"], r["reason"]) for r in similarity.assign(items, index).collect()}
    assert got.keys() == wanted.keys()
    for i, (pos, score, reason) in wanted.items():
        assert got[i][0] == pos and got[i][2] == reason and abs(got[i][1] - score) < 1e-9


@pytest.mark.parametrize("known", [0, 1, 3])
def test_batches_cluster_as_one_by_one(spark, frames, known):
    items, index = frames
    index = index.filter(F.col("pos") <= known)
    entries = index.select("pos", "text", "last_seen_at").unionByName(
        items.select((-F.col("id") - 1).alias("pos"), F.substring("text", 1, 200).alias("text"), F.col("created_at").alias("last_seen_at"))
    )
    accepted = {}
    for r in similarity.accepted(items, entries).collect():
        e = r["pos"] if r["pos"] > 0 else -(-r["pos"] - 1) - 1
        accepted.setdefault((r["id"], e), []).append((similarity.STAGES.index(r["reason"]), r["score"], r["reason"]))
    order = [r["id"] for r in items.orderBy(F.desc("collected_at"), "id").collect()]
    shifted = {(i + 1, e): v for (i, e), v in accepted.items()}
    wanted = plain.one_by_one([i + 1 for i in order], list(range(1, known + 1)), shifted)
    names = {r["pos"]: r["cluster_id"] for r in index.collect()} | {-(i + 1): text_id for i, text_id in ((r["id"], r["h"]) for r in items.select("id", text.record_hash(F.col("source"), F.col("source_id")).alias("h")).collect())}
    got = {r["id"]: (r["cluster_id"], r["reason"]) for r in clustering.assign_batch(items, index).collect()}
    assert got == {i - 1: (names[e], reason) for i, (e, reason) in wanted.items()}
    founded = {i for i, (_, reason) in got.items() if reason == "new_cluster"}
    assert len(founded) == len(NOISE) + len(TOPICS) - known


def test_a_cycle_stores_expires_and_recounts(spark, sf_dir):
    from tidemark.plans.fixtures import Tables

    t = Tables(spark, sf_dir)
    items, clusters, totals = clustering.cycle(t.assigned, t.clusters, t.as_of)
    before = t.assigned.filter("cluster_id IS NULL").count()
    told = totals.first()
    assert told["processed"] == before == told["clustered"] + told["new_clusters"]
    alive = {r["cluster_id"]: r["item_count"] for r in clusters.collect()}
    counts = {r["cluster_id"]: r["count"] for r in items.filter("cluster_id IS NOT NULL").groupBy("cluster_id").count().collect()}
    assert counts.keys() <= alive.keys() and all(alive[c] == n for c, n in counts.items()) and items.count() == t.assigned.count()
    assert clusters.filter(F.col("last_seen_at") < t.as_of - F.expr("INTERVAL 7 DAY")).count() == 0 < t.clusters.count() - len(alive) + told["new_clusters"]


def test_fuzzy_ratios_equal_plain_ones():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcd", k=rng.randrange(1, 5)))
    for _ in range(400):
        a, b = (" ".join(word() for _ in range(rng.randrange(0, 9))) for _ in range(2))
        assert abs(fuzzy.token_set_ratio(a, b) - plain.token_set_ratio(a, b)) < 1e-9 and abs(fuzzy.partial_ratio(a, b) - plain.partial_ratio(a, b)) < 1e-9
        for least in (60, 85):
            for own, wanted in ((fuzzy.token_set_ratio, plain.token_set_ratio), (fuzzy.partial_ratio, plain.partial_ratio)):
                full = wanted(a, b)
                assert abs(own(a, b, least) - (full if full >= least else 0)) < 1e-9


def test_fuzzy_keys_open_the_gate_and_raise_scores(spark):
    key = lambda label, value, weight: {"label": label, "value": value, "weight": weight}
    a = [key("ORG", "red cross society", 2.2), key("PERSON", "anna vell", 2.0), key("LAW", "act nine", 1.8)]
    b = [key("ORG", "society of red cross", 2.2), key("PERSON", "otto brann", 2.0)]
    assert fuzzy.key_overlap(a, b, 88, 30) == (True, 2.2, 4.2) and fuzzy.key_overlap(a, [], 88, 30) == (False, 0.0, 0.0)
    assert fuzzy.key_overlap([key("ORG", f"x{i:02}", 1) for i in range(40)], [key("ORG", "x35", 1)], 88, 30) == (False, 0.0, 30.0)
    rows = [(1, 0.43, 0.15, False, False, True, 2.2, 4.2), (2, 0.43, 0.15, False, False, False, 0.0, 4.2), (3, 0.41, 0.15, False, False, True, 2.2, 4.2), (4, 0.43, 0.13, False, False, True, 2.2, 4.2), (5, 0.30, 0.15, True, False, True, 2.2, 4.2), (6, 0.6, 0.2, False, False, False, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, ng double, sig double, shared_key boolean, events boolean, alike boolean, hits double, total double")
    df = df.select("id", "ng", "sig", "shared_key", "events", F.struct("alike", "hits", "total").alias("keys"))
    assert {r["id"] for r in df.filter(similarity.passes_gate()).collect()} == {1, 4, 5, 6}
    got = {r["id"]: r["s"] for r in df.select("id", similarity.boosted(similarity.Rules()).alias("s")).collect()}
    raised = 0.15 + 0.10 * 2.2 / 4.2
    assert all(abs(got[i] - s) < 1e-12 for i, s in {1: raised, 2: 0.15, 3: raised, 4: 0.13, 5: 0.15, 6: 0.2}.items())


def test_script_guard_raises_the_bar(spark):
    latin = "Breaking news from Kelmar dam on 2024-01-03 with protest and flood water"
    mixed = "гроза прошла над городом без следа, новый мост открыли рано утром, школа закрыта из за снега и льда на реке " + latin
    items = spark.createDataFrame([(1, latin, START), (2, mixed, START)], "id long, text string, created_at timestamp_ntz")
    entries = spark.createDataFrame([(1, latin, START)], "pos long, text string, last_seen_at timestamp_ntz")
    ids = lambda **rules: {r["id"] for r in similarity.semantic_matches(items, entries, similarity.Rules(**rules)).collect()}
    assert ids() == {1, 2} and ids(script_guard=True) == ids(script_guard=True, cross_script=None) == {1} and ids(script_guard=True, cross_script=0.4) == {1, 2}


def test_scripts():
    assert {s: fuzzy.script_of(s) for s in plain.SCRIPT_SAMPLES} == plain.SCRIPT_SAMPLES


def test_page_texts_equal_plain_ones(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html", fuzzy.page_text("html").alias("t")).collect():
        assert r["t"] == plain.page_text(r["html"])


def test_lexical_bounds_lose_no_pair():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcde", k=rng.randrange(1, 7)))
    base = [sorted({word() for _ in range(rng.choice((1, 2, 5, 12, 40)))}) for _ in range(40)]

    def varied(tokens):
        s = " ".join(tokens[rng.randrange(max(1, len(tokens) // 8)) :])
        for _ in range(rng.randrange(1 + len(s) // 12)):
            at = rng.randrange(len(s) + 1)
            s = s[:at] + rng.choice(["", "x", "a"]) + s[at + rng.randrange(2) :]
        return " ".join(sorted({*s.split(), *(word() for _ in range(rng.choice((0, 0, 1, 30))))})) if rng.random() < 0.5 else s

    entries = [" ".join(b)[:200].strip() for b in base] + ["", "ab", "a", "漢字 かな"]
    items = [varied(b) for b in base for _ in range(3)] + [" ".join(x for b in base for x in b), "", "a", "ab", "漢字 かな です"]
    for chunk in (16, 4096):
        lexical.CHUNK, old = chunk, lexical.CHUNK
        try:
            index = lexical.Index(list(range(len(entries))), entries)
            for item in items:
                both = [(e, fuzzy.token_set_ratio(item, c, 85), fuzzy.partial_ratio(item, c, 88)) for e, c in enumerate(entries) if item and c]
                wanted = [x for x in both if x[1] or x[2]]
                got = index.matches(item, 85, 88)
                assert [e for e, _, _ in got] == [e for e, _, _ in wanted]
                assert all(abs(a - b) < 1e-9 for g, w in zip(got, wanted) for a, b in zip(g, w))
        finally:
            lexical.CHUNK = old


def test_near_copies_equal_all_pairs(spark, sf_dir):
    from tidemark.plans import QUERIES
    from tidemark.plans.fixtures import Tables

    t = Tables(spark, sf_dir)
    canon = lambda df, key: [(r[key], r["c"]) for r in df.select(key, text.canonical(F.col("text")).alias("c")).collect() if r["c"]]
    items = canon(t.items.select("id", F.col("item_text").alias("text")), "id")
    entries = canon(similarity.index_of(t.clusters, t.as_of), "pos")
    wanted = {}
    for i, a in items:
        for e, b in entries:
            s, p = fuzzy.token_set_ratio(a, b, 85), fuzzy.partial_ratio(a, b, 88)
            if s or p:
                wanted[i, e] = (round(s, 6), round(p, 6))
    assert {(r["id"], r["pos"]): (r["token_set"], r["partial"]) for r in QUERIES["SIM-09"](spark, sf_dir).collect()} == wanted and wanted


def test_clusters_of_the_test_tables_equal_one_by_one(spark, sf_dir):
    from tidemark.plans import domain
    from tidemark.plans.fixtures import Tables

    t = Tables(spark, sf_dir)
    waiting, index = domain.waiting(t).cache(), similarity.index_of(t.clusters, t.as_of).cache()
    order = {r["id"]: k + 1 for k, r in enumerate(waiting.orderBy(F.desc("collected_at"), "id").collect())}
    turns = spark.createDataFrame(list(order.items()), "item long, turn long")
    taken = waiting.join(turns, waiting.id == turns.item).select(F.col("turn").alias("id"), "text", "created_at")
    own = taken.select(F.negate("id").alias("pos"), F.substring("text", 1, 200).alias("text"), F.col("created_at").alias("last_seen_at"))
    rules = similarity.Rules(max_candidates=similarity.MAX_ENTRIES)
    accepted = {}
    for r in similarity.accepted(taken, index.select("pos", "text", "last_seen_at").unionByName(own), rules).collect():
        accepted.setdefault((r["id"], r["pos"]), []).append((similarity.STAGES.index(r["reason"]), r["score"], r["reason"]))
    wanted = plain.one_by_one(sorted(order.values()), [r["pos"] for r in index.orderBy("pos").collect()], accepted)
    got = {order[r["id"]]: r["reason"] for r in clustering.assign_batch(waiting, index).collect()}
    assert got == {i: reason for i, (_, reason) in wanted.items()}
    assert sum(r != "new_cluster" for r in got.values()) >= 2  # links of the lexical stage


def test_few_entries_of_one_vocabulary_are_compared_letter_by_letter(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice(("an", "er", "th", "on", "re", "ti", "ha", "e", "st", "ed")) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    item = " ".join(sorted({rng.choice(words) for _ in range(250)}))
    entries = [" ".join(sorted({rng.choice(words) for _ in range(rng.randint(3, 30))})) for _ in range(200)]
    stretch = item[300:460]
    entries += [stretch, stretch[:70] + "xx" + stretch[74:], item[-90:] + " zzzz", "00 " + item[:80], stretch[::-1], "ж" * 600, item + " zz"]
    whole = {e: (fuzzy.token_set_ratio(item, c, 85.0), fuzzy.partial_ratio(item, c, 88.0)) for e, c in enumerate(entries)}
    asked, ratio = [], fuzzy.partial_ratio
    monkeypatch.setattr(fuzzy, "partial_ratio", lambda a, b, least=0.0: asked.append(b) or ratio(a, b, least))
    found = lexical.Index(list(range(1, len(entries) + 1)), entries).matches(item, 85.0, 88.0)
    assert {e: (t, p) for e, t, p in found} == {e: both for e, both in whole.items() if max(both) > 0}
    assert len(found) >= 4 and len(asked) <= len(found) + 10


def test_entries_of_a_batch_are_met_by_later_items_only(spark):
    rows = [(i, f"Flood water breaks the Kelmar dam near Ostby, thousands leave homes {'x' * (i % 3)}") for i in range(1, 7)]
    items = spark.createDataFrame(rows, "id long, text string")
    entries = spark.createDataFrame([(-i, t) for i, t in rows] + [(1, rows[0][1])], "pos long, text string")
    met = lambda earlier: {(r["id"], r["pos"]) for r in lexical.near_copies(items, entries, 85.0, 88.0, earlier).collect()}
    assert met(True) == {(i, p) for i, p in met(False) if p > 0 or -p < i} and len(met(True)) < len(met(False))


def test_features_are_compared_in_the_index_as_pair_by_pair(spark):
    kind = "id long, features array<struct<label string, value string>>"
    left = [(1, [("SEMANTIC", "protest"), ("ISO_DATE", "2024-01-01"), ("NUM", "3")]), (2, [("ORG", "acme"), ("YEAR", "2024")]), (3, [])]
    right = [(-2, [("SEMANTIC", "protest"), ("ISO_DATE", "2024-01-02")]), (4, [("ORG", "acme"), ("NUM", "3")]), (9, [])]
    pairs = spark.createDataFrame([(a, b, 0.5) for a, _ in left for b, _ in right] + [(1, 4, 0.7)], "id long, pos long, ng double")
    found = similarity.compared(pairs, spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), fuzzy_keys=False)
    weight = {"SEMANTIC": 1.3, "ISO_DATE": 0.7, "NUM": 0.7, "ORG": 2.2, "YEAR": 0.6}
    total = lambda fs: sum(weight[label] for label, _ in fs)
    got = sorted((r["id"], r["pos"], r["ng"], round(r["sig"], 9), r["shared_key"], r["events"], r["other_dates"]) for r in found.collect())
    expected = []
    for i, pos, ng in [(a, b, 0.5) for a, _ in left for b, _ in right] + [(1, 4, 0.7)]:
        a, b = set(dict(left)[i]), set(dict(right)[pos])
        union = total(a | b)
        expected.append((i, pos, ng, round(total(a & b) / union, 9) if union else 0.0, ("ORG", "acme") in a & b, (i, pos) == (1, -2), (i, pos) == (1, -2)))
    assert got == sorted(expected)
