"""Importance resampling: suffix arrays and scores against plain counting, the query against SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from llm import common, registry, resampling
from tests import oracle

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, grams):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, buckets, grams, fewest, percent, seed):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    source, goal = Counter(), Counter()
    for _, t in docs:
        source.update(map(of, features(t, grams)[1]))
    for t in target:
        goal.update(map(of, features(t, grams)[1]))
    s_all, t_all = sum(source.values()) + buckets, sum(goal.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * s_all / ((source[b] + 1) * t_all)))
    rows = []
    for i, t in docs:
        n, f = features(t, grams)
        weight = sum(gain(of(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= fewest), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in rows), key=str)


def test_suffixes_are_sorted_and_share_what_lcp_says():
    rng = random.Random(1)
    ids = np.array([rng.choice((-1, 0, 1, 2)) for _ in range(300)])
    for grams in (1, 2, 3):
        order, lcp = resampling.suffix_order(ids, grams)
        head = lambda i: tuple(ids[i : i + grams]) + (-1,) * (grams - len(ids[i : i + grams]))
        assert [head(i) for i in order] == sorted(head(i) for i in range(300))
        for a, b, n in zip(order, order[1:], lcp[1:]):
            same = 0
            while same < grams and head(a)[same] == head(b)[same] >= 0:
                same += 1
            assert same == n


def test_buckets_of_slices_equal_plain_ones():
    rng = random.Random(2)
    words = [rng.choices([b"a", b"b", "é".encode(), b"dd"], k=rng.randrange(30)) for _ in range(20)] + [[]]
    for grams in (1, 2, 3):
        of, found = resampling.slice_buckets(words, grams, 97)
        for t, w in enumerate(words):
            assert sorted(found[of == t].tolist()) == sorted(zlib.crc32(f.encode()) % 97 for f in features(b" ".join(w).decode(), grams)[1])


def test_resample_equals_a_plain_one(spark, sf_dir):
    odd = [
        (1, None), (2, ""), (3, "Ein Wort"), (3, "Ein Wort"), (None, "no id but words " * 9), (4, "x" * 5000 + " y " + "z" * 5000), (5, "a b " * 4000), (6, "!!! ... ###"), (7, "été 1x_2y a.b"),
        *[(20 + i, f"same words in every text {i % 3} " * 6) for i in range(30)],
    ]
    made = spark.createDataFrame([(i, t, 1) for i, t in odd], "doc_id long, text string, rank int").repartition(3)
    goal = spark.createDataFrame([("same words 2",), (None,), ("été",)], "text string")
    for grams, most in ((1, 100), (2, 100), (3, 1000), (2, resampling.SLICE)):  # texts cut into pieces give what whole ones give
        got = resampling.resample(made, goal, grams=grams, buckets=50, fewest_words=5, percent=40, seed=3, most=most).collect()
        wanted = plain_resample(odd, [r["text"] for r in goal.collect()], 50, grams, 5, 40, 3)
        assert sorted(map(tuple, got), key=str) == wanted
    docs = common.table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    target = [r["text"] for r in common.table(spark, sf_dir, "benchmark").collect()]
    got = resampling.resample(docs, common.table(spark, sf_dir, "benchmark")).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(rows, target, 10_000, 2, 20, 25, 7)
    assert resampling.resample(made.limit(0), goal).count() == 0 and resampling.resample(made, goal.limit(0)).count() == len(odd)


def test_query_equals_sql(spark, sf_dir):
    assert not oracle.difference(registry.QUERIES["op13_importance_resampling"](spark, sf_dir), oracle.connect(sf_dir), registry.ORACLE_SQL["op13_importance_resampling"])
