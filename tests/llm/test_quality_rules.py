"""Quality rules: measurements against a plain version, policies against the ledger."""

import random
import re
from collections import Counter

from llm import common, quality_rules as q, registry
from tests import oracle

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (5, "a b c d e f g h " * 2), (6, "a b c d e f g h i"), (7, "x " * 40), (8, "same line\nsame line\n\n \n \nsame line"),
    (8, "same line\nsame line\n\n \n \nsame line"), (9, "# $ % & | < > * " * 30), (None, "no id " * 30), (10, "w" * 100_000), (11, "été naïve x \x1c y"),
    (12, "1 2 3 4 5 " * 9), (13, " ".join(f"w{i % 11}" for i in range(3000))),
]


def plain(text):
    t = text or ""
    words = WORD.findall(t)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    letters = sum(1 for w in words if any(c.isalpha() for c in w))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(again), letters


def measured(df):
    return sorted(([r["doc_id"], *(r[m] for m in q.MEASURES)] for r in q.ledger(df).collect()), key=str)


def test_measurements_equal_plain_ones(spark, sf_dir):
    rng = random.Random(3)
    made = [(100 + i, "".join(rng.choices("ab #|\n\t", k=rng.randrange(400)))) for i in range(60)]
    odd = spark.createDataFrame([(i, t, 0, True) for i, t in ODD + made], "doc_id long, text string, n_words int, kept boolean").repartition(3)
    for df in (odd, common.table(spark, sf_dir, "documents")):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert measured(df) == sorted(([i, *plain(t)] for i, t in rows), key=str)
    assert q.ledger(odd.limit(0)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    assert not oracle.difference(registry.QUERIES["op11_quality_rules"](spark, sf_dir), oracle.connect(sf_dir), registry.ORACLE_SQL["op11_quality_rules"])


def test_policies_and_ablations_follow_from_the_bits(spark, sf_dir):
    found = q.ledger(common.table(spark, sf_dir, "documents"), groups=("source",))
    rows = found.collect()
    bits = {r.name: 1 << r.bit for r in q.RULES}

    def passes(policy, b):
        return not any(b & bits[n] for n in policy.hard) and sum(bool(b & bits[n]) for n in policy.soft) < policy.most_soft

    for policy in q.POLICIES:
        assert {r["doc_id"] for r in q.verdicts(found, policy).filter("kept").collect()} == {r["doc_id"] for r in rows if passes(policy, r["fail_bits"])}
    by = {(r["policy"], r["version"], r["left_out"]): r for r in q.ablations(found).collect()}
    assert len(by) == sum(1 + len(p.hard) + len(p.soft) for p in q.POLICIES)
    for p in q.POLICIES:
        for name in (None, *p.hard, *p.soft):
            case = q.without(p, name) if name else p
            kept = [r for r in rows if passes(case, r["fail_bits"])]
            r = by[p.name, p.version, name]
            assert (r["kept_docs"], r["kept_words"], r["kept_docs"] + r["rejected_docs"]) == (len(kept), sum(x["n_words"] for x in kept), len(rows))
    for r in q.summary(found, "source").collect():
        own = [x["fail_bits"] for x in rows if x["group_source"] == r["group_source"]]
        assert r["few_words"] == sum(b & 1 for b in own) and r["docs"] == len(own)
        assert all(bool(r["some_fail"] & bit) == any(b & bit for b in own) and bool(r["all_fail"] & bit) == all(b & bit for b in own) for bit in bits.values())


def test_the_plan_has_no_shuffle_and_no_python(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", q.measured(common.F.col("text")).alias("m"))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
