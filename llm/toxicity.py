"""Operator 5, toxicity: a counterfactual-regularised classifier.

A document is toxic if any of its words is: word probabilities are logistic in
features of the word (itself and its beginnings) and join by noisy-or. Training,
in numpy, adds pairs of labelled documents that differ in an identity term only
and penalises any change of score between them, so a neutral mention of a group
cannot raise a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out

#: Identity terms, in groups within which they are swapped.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("women", "men", "gay", "lesbian", "bisexual", "transgender", "straight"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("chrétien", "musulman", "juif", "femmes", "hommes", "immigrés"),
    ("christen", "muslime", "juden", "frauen", "männer", "flüchtlinge"),
    ("cristianos", "musulmanes", "judíos", "mujeres", "hombres", "inmigrantes"),
)
#: A word's features: itself (0) and its beginnings of these lengths.
PREFIXES = (0, 3, 4, 5, 6)
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    """Lower-cased words; their number and order do not count."""
    return set(_WORD.findall(text.lower())) if text else set()


class Model:
    """Weights of features, one table for each of PREFIXES, and the bias of a word."""

    def __init__(self, weights: list[dict[str, float]], bias: float, floor: float):
        self.weights, self.bias, self.floor = weights, float(bias), float(floor)

    def word_loss(self, words: list[str]) -> np.ndarray:
        """-log(1 - p) of each word."""
        w0, w3, w4, w5, w6 = (t.get for t in self.weights)
        logit = [w0(w, 0.0) + w3(w[:3], 0.0) + w4(w[:4], 0.0) + w5(w[:5], 0.0) + w6(w[:6], 0.0) for w in words]
        return np.logaddexp(0, np.array(logit, float) + self.bias)

    def scores(self, texts: list[str | None], cache: dict[str, float], cache_words: int = 400_000) -> np.ndarray:
        """Probability of each text. ``cache`` keeps words between calls; its size changes no score."""
        sets = [words_of(t) for t in texts]
        fresh = list(set().union(*sets).difference(cache))
        if len(cache) + len(fresh) > cache_words:
            cache.clear()
            fresh = list(set().union(*sets))
        cache.update(zip(fresh, self.word_loss(fresh).tolist()))
        total = np.array([math.fsum(map(cache.__getitem__, s)) for s in sets]) + self.floor
        return -np.expm1(-total)


def _counterfactuals(docs: list[set[str]], rng: np.random.Generator, share: float) -> Iterator[tuple[set[str], set[str]]]:
    """Pairs of a document and itself with an identity term swapped for another of its group.

    Documents that name a group are swapped as they stand; of the others a
    ``share`` gets a term first, so terms that the labels never show are
    regularised too.
    """
    group_of = {t: g for g in IDENTITY_TERMS for t in g}
    for words in docs:
        named = sorted(words & group_of.keys())
        if named:
            term = named[0]
        elif rng.random() < share:
            group = IDENTITY_TERMS[rng.integers(len(IDENTITY_TERMS))]
            term = group[rng.integers(len(group))]
        else:
            continue
        others = [t for t in group_of[term] if t != term]
        yield words | {term}, (words - {term}) | {others[rng.integers(len(others))]}
        if not named:
            yield words, words | {term}  # a bare mention is neutral


def train(
    docs: list[set[str]], labels: list[int], steps: int = 120, decay: float = 2e-3, swap_weight: float = 1.0, min_docs: int = 3, seed: int = 5
) -> Model:
    """Fit on word sets by Adam on the whole sample, with weight decay."""
    rng = np.random.default_rng(seed)
    if not any(labels):
        return Model([{} for _ in PREFIXES], -20.0, 0.0)
    terms = {t for g in IDENTITY_TERMS for t in g}
    vocabulary = {w: i for i, w in enumerate(sorted(terms.union(*docs)))}

    def numbers(words):
        return np.sort(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))

    # pairs become numbers one by one, so the driver never holds their word sets
    pairs = [(numbers(a), numbers(b)) for a, b in _counterfactuals(docs, rng, 0.2)]
    every = [*map(numbers, docs), *(a for a, _ in pairs), *(b for _, b in pairs)]
    sizes = np.array([len(d) for d in every])
    word = np.concatenate(every)
    row = np.repeat(np.arange(len(every)), sizes)
    # features that few labelled documents show carry no weight; identity terms always do
    shown = [Counter() for _ in PREFIXES]
    for d in docs:
        for k, counts in zip(PREFIXES, shown):
            counts.update({w[:k] for w in d} if k else d)
    features = [sorted({f for f, c in counts.items() if c >= min_docs} | (terms if not k else set())) for k, counts in zip(PREFIXES, shown)]
    slot_of, size = [], 1  # slot 0 is none
    for names in features:
        slot_of.append({f: size + i for i, f in enumerate(names)})
        size += len(names)
    slots = np.array([[table.get(w[:k] if k else w, 0) for k, table in zip(PREFIXES, slot_of)] for w in vocabulary], np.int64)
    y = np.array(labels, float)
    n = len(docs)
    a = np.arange(len(pairs)) + n
    b = a + len(pairs)
    theta, bias, floor = np.zeros(size), -9.0, -4.0  # floor: log of the loss of a document without words
    moments = [np.zeros(size), np.zeros(size), np.zeros(2), np.zeros(2)]
    for step in range(1, steps + 1):
        logit = theta[slots].sum(1) + bias
        loss_w, p_w = np.logaddexp(0, logit), 1 / (1 + np.exp(-logit))
        total = np.bincount(row, loss_w[word], len(every)) + np.exp(floor)
        p = -np.expm1(-total)
        d_total = np.zeros(len(every))
        q = np.clip(p[:n], 1e-7, 1)
        d_total[:n] = ((1 - y) - y * (1 - q) / q) / n
        if len(pairs):
            diff = p[a] - p[b]
            d_total[a] += 2 * swap_weight * diff * (1 - p[a]) / len(pairs)
            d_total[b] -= 2 * swap_weight * diff * (1 - p[b]) / len(pairs)
        d_word = np.bincount(word, d_total[row], len(vocabulary)) * p_w
        g = np.zeros(size)
        for k in range(slots.shape[1]):
            g += np.bincount(slots[:, k], d_word, size)
        g[0] = 0
        g += decay * theta / n
        g2 = np.array([d_word.sum() * 0.1, d_total.sum() * np.exp(floor)])
        for grad, m, v in ((g, moments[0], moments[1]), (g2, moments[2], moments[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        rate = 0.3 * (1 - step / (steps + 1))
        theta -= rate * (moments[0] / fix1) / (np.sqrt(moments[1] / fix2) + 1e-6)
        move = rate * (moments[2] / fix1) / (np.sqrt(moments[3] / fix2) + 1e-6)
        bias, floor = bias - move[0], floor - move[1]
    weights = [{f: float(theta[i]) for f, i in table.items() if theta[i]} for table in slot_of]
    return Model(weights, bias, float(np.exp(floor)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_per_class: int = 2000,
    held_out: int | None = 4,
    **how,
) -> Model:
    """Train on at most ``max_per_class`` labelled rows of each class.

    The rows are those with the smallest hashes of their ids, so the sample does
    not depend on partitioning. ``held_out`` leaves out ids whose remainder of
    that modulus is 2. Rows with null label, id or text are not used.
    """
    known = labels.filter("toxic IN (0, 1)").select(F.col(id_col).alias("_id"), "toxic").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    if held_out:
        known = known.filter(~is_held_out("_id", held_out))
    picked = None
    for value in (0, 1):
        some = known.filter(F.col("toxic") == value).orderBy(F.xxhash64("_id"), "_id").limit(max_per_class)
        picked = some if picked is None else picked.union(some)
    # at most 2 * max_per_class ids: small enough to send to every task
    sample = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("_doc") == F.col("_id"))

    def word_sets(batches):
        for batch in batches:
            sets = [sorted(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.string())), batch.column(2)], names=["id", "words", "toxic"]
            )

    rows = sample.select(F.col("_id").cast("long"), "text", F.col("toxic").cast("int")).filter("text IS NOT NULL")
    got = rows.mapInArrow(word_sets, "id long, words array<string>, toxic int").toArrow().sort_by("id")
    # one string for all places of a word
    listed = got["words"].combine_chunks()
    coded = listed.flatten().dictionary_encode()
    names, code, ends = coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))
    docs_of = [{names[i] for i in code[a:b].tolist()} for a, b in zip([0, *ends.tolist()], ends.tolist())]
    return train(docs_of, got["toxic"].to_pylist(), **how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every whole text.

    Defined results: null and empty texts have the score of a document without
    words; repeated rows are scored each; null ids are kept; an empty table
    gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                p = shared.value.scores(part.column(1).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged.

    Each row is judged by its own text where it is read, so null and repeated
    ids do not matter and repeated rows stay or go together. Defined results:
    null and empty texts have the score of a document without words; an empty
    table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **how))
    place = docs.columns.index(text_col)

    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.filter(pa.array(model.value.scores(part.column(place).to_pylist(), cache) < threshold))

    return docs.mapInArrow(run, docs.schema)
