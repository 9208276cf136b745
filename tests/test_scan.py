"""What is found in texts in one pass against Spark's expressions, and steps that are taken for many texts at once."""

import random

from pyspark.sql import functions as F

from tidemark.functions import ngrams, scan, text
from tidemark.operators import lexical, similarity

PARTS = [
    "a", "killed", "Killed", "THE", "protests", "war", "12", "1,234", "12,34", "1999", "2100", "2024-01-03", "3 days", "5Hours", "7weekſ", "10% x", "10%x", "50 %x", "_12", "1_", "a1b",
    "http://x.y/é", "HTTPS://A.B", "https://ex.com/a,b", "www.Foo-bar.co.uk", "a..bc", "-.ab", "x.y1", "foo.bar_", "é.com", "é-a.com", "@you", "#tag", "#", "@", "😀😀", " ", "　", "\n", "\t", "\x1c",
    "漢字かな", "слово", "ΟΔΟΣ", "İstanbul", "straße", "'", "-", ",", ".", "%", "9%", "RT @me: ", "rt  @You_1:", "a,b;c", "12345678901", "0,123,456", "3\tyears", "4years5", "½", "²", "blackout blackout",
]


def test_one_pass_finds_what_the_expressions_find(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PARTS) + rng.choice([" ", "", " "]) for _ in range(rng.randrange(15)))) for i in range(4000)]
    named = text.with_words(spark.createDataFrame(rows, "id long, t string").withColumn("r", text.strip_retweet(F.col("t"))), "r")
    r = F.col("r")
    found = [F.transform(text.find_all(r, text.URL), F.lower), F.transform(text.find_all(r, text.DOMAIN), F.lower), text.numbers(r), text.percents(r), text.time_windows(r), text.find_all(r, text.ISO_DATE), text.find_all(r, text.YEAR)]
    found = F.array(*map(F.array_distinct, found), text.semantic_tokens(F.col("words"), F.col("hits")))
    for row in named.select("t", found.alias("f"), text.canonical(F.col("t")).alias("c"), text.ngram_text(F.col("t")).alias("n")).collect():
        assert (scan.features(row["t"]), scan.canonical(row["t"]), scan.ngram_text(row["t"])) == (row["f"], row["c"], row["n"]), row["t"]


def test_grams_of_narrow_texts_are_numbers(monkeypatch):
    monkeypatch.setattr(ngrams, "_counted", lambda texts: 1 / 0)
    texts = ["", "a", "naïve слово ab ab", "weiß ไทย"]
    for t, (buckets, n) in zip(texts, ngrams._vectors(texts, {})):
        wanted = {}
        for g, k in ngrams.grams_of(t).items():
            wanted[ngrams.bucket_of(g)] = wanted.get(ngrams.bucket_of(g), 0) + k
        assert dict(zip(buckets.tolist(), n.tolist())) == wanted


def test_windows_of_many_texts_are_looked_at_together(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice(("an", "er", "th", "on", "re", "ti", "ha", "e")) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    items = ["", *(" ".join(sorted({rng.choice(words) for _ in range(rng.randint(5, 200))})) for _ in range(40))]
    index = lexical.Index(list(range(12)), [items[k * 3 + 1][:150].strip() for k in range(12)])
    alone = [index.matches(item, 85.0, 88.0) for item in items]
    asked, in_order = [], lexical.Index.in_order
    monkeypatch.setattr(lexical.Index, "in_order", lambda *a: asked.append(a) or in_order(*a))
    assert index.matches_of(items, 85.0, 88.0, [None] * len(items)) == alone and sum(map(len, alone)) >= 12
    assert len(asked) == len(lexical.STEPS)


def test_only_items_of_near_pairs_are_asked_for_features(spark):
    items = spark.createDataFrame([(1, "Flood water breaks the Kelmar dam"), (2, "Old violin found in attic"), (3, "Flood water at the dam of Kelmar")], "id long, text string")
    entries = spark.createDataFrame([(1, "Flood water breaks the Kelmar dam near Ostby")], "pos long, text string")
    near = similarity.near_pairs(items, entries, similarity.Rules(), earlier=False)
    fa, fb = similarity.signatures_of(items, entries, None, near)
    assert sorted(r["id"] for r in fa.collect()) == sorted({r["id"] for r in near.collect()}) == [1, 3] and fb.count() == 1
