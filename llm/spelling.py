"""Operator 12, spelling variants: an errata trie over the corpus' words.

Two words are near if one inserted, deleted or replaced letter makes them
equal. In a trie of all words such a pair parts at one node: from there on one
word's rest equals the other's with the letter at that node skipped (an indel)
or with both letters skipped (a replacement). So errata are merged node by node:

* Small subtrees lie in one task each. At every node the light children are
  merged, smaller into larger, into a trie of what follows one replaced letter,
  and that and every child, its letter skipped, is walked along the heavy child
  or the node itself. Terminals that coincide are near words. A walk costs no
  more than the smaller side, and a word is in a light child of few nodes.
* Nodes with more letters below them than a task may hold, near the root, are
  merged by a shuffle: their words meet by what is left of them after the error.
  Such a key has one exact word and at most one for each letter beside it, so no
  key is hot.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Letters of a run; A-Z are lowered, no other is.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Letters below a node that is merged in one task, summed over its words.
#: A letter takes some 200 bytes there.
TASK_LETTERS = 200_000


def runs(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``(doc_id, run)``: every maximal run of ``least`` letters or more, A-Z lowered."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    # not ``explode``, which would extract once more to see whether there is any
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(found).alias("run")).filter("run IS NOT NULL")
    return each.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))


def damaged(doc_id: Column, run: Column, every: int) -> Column:
    """``run`` without one letter where ``every`` divides its hash; the hash says which."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, fewest: int = 2, damage: int | None = None) -> DataFrame:
    """``(word, n)`` of words of ``shortest`` letters or more that occur ``fewest`` times or more.

    With ``damage`` every so manieth run, by its hash, loses a letter first: a
    planted misspelling. Counts are combined before they are shuffled. A null
    text has no words; a null id is hashed as an empty one; repeated rows count
    each.
    """
    word = F.col("run") if damage is None else damaged(F.col("doc_id"), F.col("run"), damage)
    words = runs(docs, id_col, text_col, shortest).select(word.alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


class Node:
    __slots__ = ("next", "words", "size")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.words: list[int] | None = None  # whose rest ends here
        self.size = 0  # words at or below


def build(words: list[str]) -> Node:
    root = Node()
    for i, w in enumerate(words):
        at = root
        at.size += 1
        for ch in w:
            below = at.next.get(ch)
            if below is None:
                below = at.next[ch] = Node()
            at = below
            at.size += 1
        at.words = [i]
    return root


def coincide(a: Node, b: Node, skip: str | None, pairs: list[tuple[int, int]]) -> None:
    """Append every two words whose rests end at the same place below ``a`` and ``b``; the branch ``skip`` of ``b`` is left out."""
    if a.words and b.words:
        pairs.extend((x, y) for x in a.words for y in b.words)
    few, many = (a.next, b.next) if len(a.next) <= len(b.next) else (b.next, a.next)
    turned = few is not a.next
    open_ = [(few[ch], many[ch]) for ch in few if ch != skip and ch in many]
    while open_:
        x, y = open_.pop()
        if x.words and y.words:
            u, v = (y, x) if turned else (x, y)
            pairs.extend((p, q) for p in u.words for q in v.words)
        if len(x.next) <= len(y.next):
            open_.extend((c, y.next[ch]) for ch, c in x.next.items() if ch in y.next)
        else:
            open_.extend((x.next[ch], c) for ch, c in y.next.items() if ch in x.next)


def graft(onto: Node, light: Node, pairs: list[tuple[int, int]]) -> None:
    """Copy ``light`` into ``onto``; words that end where others do are pairs."""
    open_ = [(onto, light)]
    while open_:
        to, of = open_.pop()
        if of.words:
            if to.words:
                pairs.extend((x, y) for x in to.words for y in of.words)
            to.words = [*(to.words or ()), *of.words]
        for ch, c in of.next.items():
            below = to.next.get(ch)
            if below is None:
                below = to.next[ch] = Node()
            open_.append((below, c))


def near_pairs(words: list[str]) -> list[tuple[int, int]]:
    """Every two of some distinct words that differ by one edit, as positions, once each."""
    pairs: list[tuple[int, int]] = []
    open_ = [build(words)]
    while open_:
        v = open_.pop()
        children = sorted(v.next.items(), key=lambda kv: -kv[1].size)
        open_.extend(c for _, c in children if c.size > 1)
        if len(children) + (v.words is not None) < 2:
            continue
        # one letter skipped: what follows it ends where a word of another branch does
        for ch, c in children:
            coincide(c, v, ch, pairs)
        # one letter replaced: light children become one trie, which is walked along the heavy child
        if len(children) > 1:
            merged = children[1][1]
            if len(children) > 2:
                merged = Node()
                for _, light in children[1:]:
                    graft(merged, light, pairs)
            coincide(merged, children[0][1], None, pairs)
    return pairs


#: Per word: how many near words a part of the trie has, and the best of them.
NEAR = "word string, n_near long, near_n long, near string"


def _merge_groups(held: DataFrame) -> DataFrame:
    """NEAR of the words of ``held(part, word, n)``, each ``part`` a subtree that fits a task."""

    def merge(words: list[str], ns: list[int]):
        count = [0] * len(words)
        best: list[tuple[int, str] | None] = [None] * len(words)
        for x, y in near_pairs(words):
            for a, b in ((x, y), (y, x)):
                count[a] += 1
                new = (-ns[b], words[b])
                if best[a] is None or new < best[a]:
                    best[a] = new
        return [(words[i], count[i], -best[i][0], best[i][1]) for i in range(len(words)) if count[i]]

    def run(batches):
        part, words, ns = None, [], []
        out: list[tuple] = []
        for batch in batches:
            for p, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    out += merge(words, ns)
                    part, words, ns = p, [], []
                words.append(w)
                ns.append(n)
            if out:
                yield _batch(out)
                out = []
        out += merge(words, ns)
        if out:
            yield _batch(out)

    parts = shuffle_partitions(held.sparkSession)
    return held.select("part", "word", "n").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, NEAR)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    word, n_near, near_n, near = zip(*rows)
    columns = [pa.array(word, pa.string()), pa.array(n_near, pa.int64()), pa.array(near_n, pa.int64()), pa.array(near, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "near_n", "near"])


def _merge_node(held: DataFrame) -> DataFrame:
    """NEAR of pairs that part at depth ``depth`` of ``held(word, n, depth)``, each row a word under a node of that depth.

    A word stands at its own rest, and at the rest after the letter at the node
    is skipped. The node's path is part of the key, so one key holds the words
    that are alike but for one place.
    """
    ch = F.substring("word", F.col("depth") + 1, F.lit(1))
    path = F.substring("word", F.lit(1), F.col("depth"))
    skipped = F.concat(path, F.substring("word", F.col("depth") + 2, F.length("word")))
    sides = F.array(
        F.struct(F.col("word").alias("key"), F.lit(None).cast("string").alias("skipped")),
        F.struct(F.when(F.length("word") > F.col("depth"), skipped).alias("key"), ch.alias("skipped")),
    )
    # the letter that a whole word has at the node: a skipped one must differ, or the two part further down
    rows = held.select("depth", "word", "n", F.explode(sides).alias("s")).select("depth", "word", "n", "s.*", ch.alias("ch")).filter("key IS NOT NULL")
    me = F.struct("word", "n", "skipped", "ch")
    met = rows.groupBy("depth", "key").agg(F.collect_list(me).alias("all")).filter(F.size("all") > 1)  # one of each letter, and one whole
    pairs = met.select("all", F.explode("all").alias("me")).select("me", F.explode("all").alias("other"))
    differs = F.coalesce(F.col("me.skipped"), F.col("me.ch")) != F.coalesce(F.col("other.skipped"), F.col("other.ch"))
    both_whole = F.col("me.skipped").isNull() & F.col("other.skipped").isNull()
    pairs = pairs.filter((F.col("me.word") != F.col("other.word")) & differs & ~both_whole)
    return pairs.select(F.col("me.word").alias("word"), F.col("other.word").alias("near"), F.col("other.n").alias("near_n")).transform(_best)


def _best(pairs: DataFrame) -> DataFrame:
    """NEAR of ``pairs(word, near, near_n)``: how many, and the most frequent, the smallest of equals."""
    top = F.min(F.struct(F.negate("near_n").alias("n"), F.col("near").alias("w")))
    return pairs.groupBy("word").agg(F.count("*").alias("n_near"), top.alias("t")).select("word", "n_near", F.negate("t.n").alias("near_n"), F.col("t.w").alias("near"))


def nearest(counts: DataFrame, task_letters: int = TASK_LETTERS) -> DataFrame:
    """NEAR of every word of ``counts(word, n)`` that has a near word; words are distinct.

    From the root down, a node with more than ``task_letters`` letters below it
    is merged by a shuffle and its children are looked at next; all others are
    dealt to tasks whole. Steps down go straight to where words part, so there
    are as many rounds as crowded nodes on one path.
    """
    spark = counts.sparkSession
    letters = F.sum(F.length("word")).alias("letters")
    # the most letters of a node that a task takes; there are never more than 10,000 nodes above it at one depth
    total = counts.agg(letters).first()["letters"] or 0
    most = max(task_letters, total // 10_000)
    found: DataFrame | None = None
    open_ = counts.select("word", "n", F.lit(0).alias("depth"))
    while True:
        path = F.substring("word", F.lit(1), F.col("depth"))
        nodes = open_.groupBy("depth", path.alias("path")).agg(letters, F.count("*").alias("words"), F.min("word").alias("low"), F.max("word").alias("high"))
        # in code-point order all words between two ends share what the ends share
        alike = F.zip_with(F.split("low", ""), F.split("high", ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
        shared = (F.array_position(alike, False) - 1).cast("int")
        crowded = nodes.filter((F.col("letters") > most) & (F.col("words") > 1)).select("depth", "path", shared.alias("parts_at"))
        crowded = materialize(crowded, "spelling-crowded")
        joined = open_.withColumn("path", path).join(F.broadcast(crowded), ["depth", "path"], "left")
        joined = materialize(joined.drop("path"), "spelling-open")
        calm = joined.filter("parts_at IS NULL").select("word", "n", F.concat_ws(":", "depth", F.substring("word", F.lit(1), F.col("depth"))).alias("part"))
        parts = [_merge_groups(calm)]
        above = joined.filter("parts_at IS NOT NULL").select("word", "n", F.col("parts_at").alias("depth"))
        last = crowded.isEmpty()
        if not last:
            parts.append(_merge_node(above))
        for p in parts:
            p = materialize(p, "spelling-near")
            found = p if found is None else found.unionByName(p)
        if last:
            break
        # a word that ends at the node is done: nothing of it lies below
        open_ = above.filter(F.length("word") > F.col("depth")).withColumn("depth", F.col("depth") + 1)
    top = F.min(F.struct(F.negate("near_n").alias("n"), F.col("near").alias("w")))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("t"))
    return best.select("word", "n_near", F.negate("t.n").alias("near_n"), F.col("t.w").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: where ``forms(word, form)`` lead, by jumps that double; a form is ten times as frequent, so chains end."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialize(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        found = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return found


def variant_groups(counts: DataFrame, ratio: int = 10, task_letters: int = TASK_LETTERS) -> DataFrame:
    """Per word of ``counts(word, n)``: ``form``, ``root``, ``n_near``, ``form_n``.

    A word's form is its most frequent near word (of equals the smallest in
    code-point order), if that is ``ratio`` times as frequent or more; the root
    is where forms lead, the word itself if it has none. Defined results: words
    are distinct and not null; a single word, and a table without any, have no
    near words; words of any length are taken whole.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants, or they could go round")
    near = nearest(counts, task_letters)
    is_form = F.col("near_n") >= ratio * F.col("n")
    named = counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
    )
    named = materialize(named, "spelling-forms")
    roots = _roots(named.filter("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, fewest: int = 2, ratio: int = 10, damage: int | None = None
) -> DataFrame:
    """``variant_groups`` of the words of all texts; see ``word_counts`` for what a word is."""
    return variant_groups(materialize(word_counts(docs, id_col, text_col, shortest, fewest, damage), "spelling-counts"), ratio)
