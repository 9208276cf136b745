"""Operator 13, importance resampling towards a target: n-gram buckets from suffix arrays.

The words of a slice of texts become ids, and their suffixes are sorted by the
ids that follow. Where neighbours in that order share a prefix of k ids (the
LCP array) they hold the same k-gram, so a run of them is hashed once and its
bucket goes back to every place it occurs. Bucket counts of the corpus and of
the target give every bucket a gain in likelihood; a text's weight is the mean
gain of its n-grams. Weights and Gumbel noise, which hashes of ids stand for,
draw without replacement the texts of the highest scores.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, utf8
from .order import place_rows

#: Letters and digits of ASCII and all beyond it, in UTF-8: no byte of a longer character is one of ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Bytes of a slice, all of whose suffixes are sorted at once; longer texts are cut between words.
SLICE = 4_000_000


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """``text`` in pieces of at least ``most`` bytes but the last, cut where no word is."""
    at = 0
    while len(text) - at > most:
        end = at + most
        inside = WORD.match(text, end)
        end = inside.end() if inside else end
        yield text[at:end]
        at = end
    yield text[at:]


def suffix_order(ids: np.ndarray, grams: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``ids`` in the order of their first ``grams`` ids, and the LCP of each with the one before it, at most ``grams``.

    An id below 0 ends a text: no common prefix goes beyond it.
    """
    n = len(ids)
    shifted = [np.concatenate((ids[k:], np.full(min(k, n), -1, ids.dtype))) for k in range(grams)]
    base = int(ids.max(initial=0)) + 2
    if base**grams < 1 << 62:  # one number holds all that is compared
        key = np.zeros(n, np.int64)
        for s in shifted:
            key = key * base + (s + 1)
        order = np.argsort(key)
    else:
        order = np.lexsort(shifted[::-1])
    lcp = np.zeros(n, np.int64)
    same = np.ones(max(n - 1, 0), bool)
    for s in shifted:
        sorted_ids = s[order]
        same &= (sorted_ids[1:] == sorted_ids[:-1]) & (sorted_ids[1:] >= 0)
        lcp[1:] += same
    return order, lcp


def slice_buckets(words: list[list[bytes]], grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, bucket)`` of every n-gram of up to ``grams`` words in some texts, repeats included, by position.

    A run's hash goes on from that of its first words, which is known.
    """
    size = np.array([len(w) for w in words], np.int64)
    coded = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    ends = np.cumsum(size + 1) - 1
    a = np.full(int(size.sum()) + len(words), -1, np.int64)
    inside = np.ones(len(a), bool)
    inside[ends] = False
    a[inside] = coded.indices.to_numpy()
    text = np.repeat(np.arange(len(words)), size + 1)
    left = np.repeat(ends, size + 1) - np.arange(len(a))  # words from each place to its text's end
    order, lcp = suffix_order(a, grams)
    first = np.array([zlib.crc32(w) for w in vocabulary], np.int64)
    later = np.array([b" " + w for w in vocabulary], object)
    hashed = np.where(a >= 0, first[a] if len(first) else 0, 0)  # by place, of the k-gram that begins there
    of, found = [], []
    for k in range(1, grams + 1):
        whole = left[order] >= k
        places, shared = order[whole], lcp[whole]
        # those with fewer words left sort first among equals, so none parts a run of k-grams
        starts = np.flatnonzero(shared < k)
        heads = places[starts]
        if k > 1:
            runs = [zlib.crc32(w, c) for w, c in zip(later[a[heads + k - 1]].tolist(), hashed[heads].tolist())]
            hashed[places] = np.repeat(np.array(runs, np.int64), np.diff(np.append(starts, len(places))))
        of.append(text[places])
        found.append(hashed[places] % buckets)
    return np.concatenate(of), np.concatenate(found)


def _slices(texts: list[bytes], grams: int, most: int) -> Iterator[tuple[list, list[list[bytes]], list[int]]]:
    """Slices of ``(row, words, own)``: a later piece of a text begins with the last words of the piece before, ``own`` says how many."""
    rows, words, borrowed, size = [], [], [], 0
    for row, text in enumerate(texts):
        last: list[bytes] = []
        for piece in pieces(text.lower(), most):  # of bytes: A-Z only
            own = WORD.findall(piece)
            rows.append(row)
            words.append(last + own)
            borrowed.append(len(last))
            last = (last + own)[-(grams - 1) :] if grams > 1 else []
            size += len(piece)
            if size >= most:
                yield rows, words, borrowed
                rows, words, borrowed, size = [], [], [], 0
    if rows:
        yield rows, words, borrowed


def _batch_buckets(batch: pa.RecordBatch, grams: int, buckets: int, most: int):
    """Per slice of a batch: row numbers, words of each, and ``(text, bucket)`` of its own n-grams."""
    for rows, words, borrowed in _slices(batch.column(batch.num_columns - 1).to_pylist(), grams, most):
        of, found = slice_buckets(words, grams, buckets)
        own = np.array([len(w) - b for w, b in zip(words, borrowed)], np.int64)
        # n-grams that lie in borrowed words were counted with the piece before
        for t in [t for t, b in enumerate(borrowed) if b]:
            again = slice_buckets([words[t][: borrowed[t]]], grams, buckets)[1]
            at = np.flatnonzero(of == t)
            drop: list[int] = []
            for b in again.tolist():
                drop.append(next(int(i) for i in at if found[i] == b and int(i) not in drop))
            keep = np.ones(len(of), bool)
            keep[drop] = False
            of, found = of[keep], found[keep]
        yield np.array(rows), own, of, found


def bucket_counts(docs: DataFrame, text_col: str = "text", grams: int = 2, buckets: int = 10_000, most: int = SLICE) -> DataFrame:
    """``(bucket, n)``: n-grams of all texts by bucket; a task gives one row for each bucket it met at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in _batch_buckets(batch, grams, buckets, most):
                total += np.bincount(found, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    return docs.select(utf8(text_col).alias("body")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Per bucket floor(1000 * ln) of target share over source share, both with one added to each bucket."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    share = lambda b: ((target.get(b, 0) + 1.0) * s_all) / ((source.get(b, 0) + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(share(b))) for b in range(buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", grams: int = 2, most: int = SLICE) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: a text's weight is the floored mean gain of its n-grams, 0 if it has none."""
    table = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches):
        gain = table.value
        for batch in batches:
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for rows, own, of, found in _batch_buckets(batch, grams, len(gain), most):
                held = np.bincount(of, minlength=len(rows))
                np.add.at(n_words, rows, own)  # a long text has more than one piece
                np.add.at(n, rows, held)
                by_text = np.argsort(of, kind="stable")
                sums = np.concatenate(([0], np.cumsum(gain[found[by_text]])))
                upto = np.cumsum(held)
                np.add.at(total, rows, sums[upto] - sums[upto - held])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], names=["doc_id", "n_words", "n_features", "weight"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of the seed and the id, floored; a null id is hashed as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5).cast("double")) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", grams: int = 2, buckets: int = 10_000,
    fewest_words: int = 20, percent: int = 25, seed: int = 7, most: int = SLICE,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_features``, ``weight``, ``score``, and ``rank`` from 1 of those that are drawn.

    Of the documents of ``fewest_words`` words or more, ``percent`` in a hundred
    are drawn, rounded down. Defined results: null and empty texts have weight
    0 and are never drawn unless ``fewest_words`` is 0; equal scores go by
    smaller id; repeated rows are ranked each; a null id comes first among
    equals; an empty target or table gives gains all the same.
    """
    def counted(df, col):
        return {r["bucket"]: r["n"] for r in bucket_counts(df, col, grams, buckets, most).collect()}  # a row per bucket

    gain = gains(counted(docs, text_col), counted(target, target_col), buckets)
    weighed = weights(docs, gain, id_col, text_col, grams, most)
    scored = materialize(weighed.withColumn("score", (F.col("weight") + noise("doc_id", seed)).cast("long")), "resampling-scores")
    enough = F.col("n_words") >= fewest_words
    drawn = scored.filter(enough).count() * percent // 100
    ranked = place_rows(scored.filter(enough).withColumn("against", F.negate("score")), ["against", "doc_id"], "resampling-order")
    ranked = ranked.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1).cast("long"))
    others = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(others.select(columns))
