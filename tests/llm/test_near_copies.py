"""Links between candidates of near-copy groups."""

import numpy as np

from llm import near_copies, simhash


def test_links_of_a_large_group_grow_with_its_texts(spark):
    # 300 texts share keys whose smallest texts are eight, one shares its key with another only, and two are apart
    met = [(d, a) for d in range(8, 308) for a in range(8)] + [(a, a) for a in range(8)] + [(400, 307), (501, 500), (500, 500)]
    links = [tuple(r) for r in near_copies._hooked(spark.createDataFrame(met, "digest long, a long")).collect()]
    assert len(links) == len(set(links)) <= 320

    root = {n: n for pair in links for n in pair}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {find(n) for n in range(308)} == {0} and find(400) == 0 and find(501) == 500


def test_close_fingerprints_are_candidates_where_no_band_is_shared(spark, monkeypatch):
    texts = [" ".join(f"w{(k * k + k * seed) % 7919}" for k in range(600)) for seed in (3, 5)]
    texts += [texts[0] + " more", texts[1].upper(), "short"]
    prints = [simhash.print_of(near_copies.shingle_set(t.encode(), 5)) for t in texts]
    assert 0 < (prints[0] ^ prints[2]).bit_count() <= 4 < (prints[0] ^ prints[1]).bit_count()
    monkeypatch.setattr(near_copies, "_band_keys", lambda s: np.arange(near_copies.BANDS) + near_copies._digest(s) % (1 << 40) * 64)
    found = near_copies.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 4}


def test_links_of_prints_connect_what_is_close(spark):
    rows = [(1, 0b0), (2, 0b0), (3, 0b1111), (4, 0b11111111), (5, 0b1 << 40 | 0b11111 << 50), (6, -1), (7, -1)]
    links = near_copies._by_print(spark.createDataFrame(rows, "digest long, print long"), 4)
    assert {r["node"]: r["label"] for r in near_copies.connected_components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6}
