"""Spelling variants: the trie against all pairs, crowded nodes against tasks, the query against SQL."""

import random

import pytest

from llm import registry, spelling
from tests import oracle


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts, ratio):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts)


def made_words(rng, n, letters="abcé", longest=9):
    return {"".join(rng.choices(letters, k=rng.randrange(1, longest))): rng.choice((2, 3, 30, 40, 500, 7000)) for _ in range(n)}


def test_trie_gives_each_near_pair_once():
    rng = random.Random(5)
    for n in (0, 1, 2, 30, 400):
        words = sorted(made_words(rng, n))
        got = sorted(tuple(sorted(p)) for p in spelling.near_pairs(words))
        assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]
    # a run of one letter, whose errors could stand at any of its places; a word that ends where another goes on
    assert sorted(spelling.near_pairs(["aaa", "aaaa", "aaab", "aab"])) and len(spelling.near_pairs(["aaa", "aaaa"])) == 1


@pytest.mark.parametrize("task_letters", [1, 25, 300, 10_000])
def test_crowded_nodes_give_the_same(spark, monkeypatch, task_letters):
    rng = random.Random(task_letters)
    counts = made_words(rng, 300) | {"c" * 400 + "ab": 5, "c" * 400 + "b": 50, "c" * 401 + "ab": 500}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = spelling.variant_groups(df, 10, task_letters).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == plain_groups(counts, 10)


def test_words_of_odd_rows(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, "Straßen straßen STRASSEN", "x"), (3, "Straßen straßen STRASSEN", "x"), (None, "Ärgerlich Ärgerlich ärgerlich", "x"), (4, "short words only", "x"),
        (5, "a" * 200_000 + " " + "a" * 200_000, "x"), (6, "ab1cdefgh×÷abc", "x"),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    got = {r["word"]: r["n"] for r in spelling.word_counts(odd).collect()}
    assert got == {"straßen": 4, "strassen": 2, "Ärgerlich": 2, "a" * 200_000: 2}
    assert {r["word"]: r["n_near"] for r in spelling.spelling_variants(odd).collect()} == dict.fromkeys(got, 0)
    assert spelling.spelling_variants(odd.limit(0)).count() == 0
    assert spelling.word_counts(odd, damage=1).filter("word = 'straßen'").count() == 0  # every run loses a letter
    with pytest.raises(ValueError):
        spelling.variant_groups(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_query_equals_sql(spark, sf_dir):
    assert not oracle.difference(registry.QUERIES["op12_spelling_variants"](spark, sf_dir), oracle.connect(sf_dir), registry.ORACLE_SQL["op12_spelling_variants"])
