"""Operator 11, quality rules: a ledger of rule bits, and policies over it.

A text is measured once. Every rule is a comparison of measurements and sets
one bit where it fails, so the ledger holds, per document, its measurements and
one integer of failure bits. A policy is a mask over those bits: verdicts,
their later versions and ablations never read a text again. All of it is
DataFrame functions; no row leaves its task before it is measured.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Between words: space and \x09-\x0D.
BLANK = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: What is measured of a text, all long.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words")


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails``, a SQL condition over measurements, holds. ``bit`` is its place in the ledger, for good."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("short_words", 2, "word_chars < 2 * n_words"),
    Rule("long_words", 3, "word_chars > 20 * n_words"),
    Rule("some_symbols", 4, "10 * n_symbols > n_words"),
    Rule("many_symbols", 5, "n_symbols > n_words"),
    Rule("repeated_lines", 6, "100 * n_dup_lines > 50 * n_lines"),
    Rule("few_letters", 7, "100 * n_letter_words < 50 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """Rejects what fails any rule of ``hard``, or ``most_soft`` or more of the rules of ``soft``."""

    name: str
    version: int
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    most_soft: int = 1


#: The first version is strict on symbols; the second leaves tables and lists alone.
POLICIES = (
    Policy("web", 1, ("few_words", "repeated_windows", "short_words", "long_words", "some_symbols", "repeated_lines", "few_letters")),
    Policy("web", 2, ("few_words", "repeated_windows", "many_symbols"), ("short_words", "long_words", "some_symbols", "repeated_lines", "few_letters"), 2),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used: the optimizer may copy a column, but no lambda's argument."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _twice(sorted_pairs: Column) -> Column:
    """Of sorted ``(key, at)`` structs those whose key a neighbour has, too."""
    same = lambda p, j: p["key"].eqNullSafe(F.get(sorted_pairs, j)["key"])
    return F.filter(sorted_pairs, lambda p, j: same(p, j - 1) | same(p, j + 1))


def _covered(at: Column, width: int) -> Column:
    """How many positions the windows that begin ``at`` (ascending) cover."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    add = lambda a, i: F.struct((a["n"] + (i + width - F.greatest(i, a["end"]))).alias("n"), (i + width).alias("end"))
    return F.aggregate(at, none, add, lambda a: a["n"])


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more.

    Windows are hashed first; only where a hash comes twice are windows
    themselves compared, so the count is exact.
    """

    def exact(found: Column) -> Column:
        keyed = F.transform(found, lambda p: F.struct(F.array_join(F.slice(words, p["at"] + 1, width), " ").alias("key"), p["at"].alias("at")))
        return _let(F.sort_array(keyed), lambda s: _covered(F.sort_array(F.transform(_twice(s), lambda p: p["at"])), width))

    def of(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
        repeats = _let(pairs, lambda s: _let(_twice(s), exact))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(repeats)

    windows = lambda hashes: F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width)))
    several = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: _let(windows(hashes), of))
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(several)


def measured(text: Column) -> Column:
    """The struct of MEASURES of a text; null has none of anything."""
    body = F.coalesce(text, F.lit(""))
    inner = F.btrim(body, F.lit(BLANKS))
    split = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{BLANK}]+"))
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    of_words = _let(
        split, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))
    )
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    counts = F.struct(
        of_words.alias("w"), of_lines.alias("l"), F.regexp_count(body, F.lit(SYMBOLS)).alias("n_symbols"),
        F.regexp_count(body, F.lit(rf"\p{{L}}[^{BLANK}]*")).alias("n_letter_words"),
    )
    places = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    return _let(counts, lambda c: F.struct(*[(c[places[m]][m] if m in places else c[m]).cast("long").alias(m) for m in MEASURES]))


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """The bits of the rules that fail, over columns named as in MEASURES."""
    if len({r.bit for r in rules}) != len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule has a bit of its own below 63")
    out = F.lit(0).cast("long")
    for r in rules:
        out = out.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``doc_id``, the measurements, ``fail_bits``, and ``group_<name>`` for columns that summaries ask for.

    One pass without a shuffle, written as a table: policies read that table
    alone. Defined results: null and empty texts have zero of everything and
    fail ``few_words``; repeated rows and null ids are rows like any other;
    columns of ``docs`` that are not asked for are ignored, whatever their
    names; an empty table gives an empty ledger.
    """
    m = docs.select(F.col(id_col).alias("doc_id"), measured(F.col(text_col)).alias("m"), *[F.col(g).alias(f"group_{g}") for g in groups])
    rows = m.select("doc_id", *[F.col(f"m.{x}").alias(x) for x in MEASURES], *[f"group_{g}" for g in groups])
    # measurements are written before rules read them: a rule may name one many times
    stored = materialize(rows, "quality-measures")
    return stored.withColumn("fail_bits", fail_bits(rules))


def _mask(names: tuple[str, ...], rules: tuple[Rule, ...]) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in names)


def rejected(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str = "fail_bits") -> Column:
    """Whether ``policy`` rejects a row of the ledger."""
    b = F.col(bits)
    hard = b.bitwiseAND(F.lit(_mask(policy.hard, rules)).cast("long")) != 0
    soft = F.bit_count(b.bitwiseAND(F.lit(_mask(policy.soft, rules)).cast("long"))) >= policy.most_soft
    return hard | (soft if policy.soft else F.lit(False))


def verdicts(found: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``kept`` and ``policy``, the name and version that decided."""
    return found.withColumns({"kept": ~rejected(policy, rules), "policy": F.lit(f"{policy.name}/{policy.version}")})


def without(policy: Policy, name: str) -> Policy:
    """``policy`` without one of its rules."""
    keep = lambda names: tuple(n for n in names if n != name)
    return replace(policy, hard=keep(policy.hard), soft=keep(policy.soft))


def ablations(found: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and each of its rules (null: none left out): documents and words kept and rejected without that rule.

    The ledger is first counted by its failure bits, of which there are at most
    2 to the number of rules, whatever the number of documents; policies are
    applied to those counts.
    """
    patterns = found.groupBy("fail_bits").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))
    cases = []
    for p in policies:
        for name in (None, *p.hard, *p.soft):
            case = p if name is None else without(p, name)
            cases.append(
                F.struct(
                    F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(name).cast("string").alias("left_out"),
                    rejected(case, rules).alias("out"),
                )
            )
    each = patterns.select("docs", "words", F.explode(F.array(*cases)).alias("c")).select("docs", "words", "c.*")
    kept = lambda c: F.sum(F.when(~F.col("out"), F.col(c)).otherwise(0)).alias(f"kept_{c}")
    lost = lambda c: F.sum(F.when(F.col("out"), F.col(c)).otherwise(0)).alias(f"rejected_{c}")
    return each.groupBy("policy", "version", "left_out").agg(kept("docs"), lost("docs"), kept("words"), lost("words"))


def summary(found: DataFrame, group: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per value of a group column: documents, rules that some and that all of them fail, and how many fail each."""
    fails = [F.sum(F.shiftright("fail_bits", r.bit).bitwiseAND(F.lit(1).cast("long"))).alias(r.name) for r in rules]
    return found.groupBy(f"group_{group}").agg(F.count("*").alias("docs"), F.bit_or("fail_bits").alias("some_fail"), F.bit_and("fail_bits").alias("all_fail"), *fails)
