"""Character n-grams of whole texts, counted where a text is read.

A text has thousands of n-grams, of which most repeat. As rows they would be
exploded and grouped again; counted in Arrow batches, only the counts are rows,
and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan, text

#: Buckets of n-grams that a worker keeps at most, over all of its tasks; more are hashed again.
KNOWN = 1 << 20
_known: dict[str | int, int] = {}
#: Bits of a character of texts whose n-grams are numbers by themselves: letters up to Thai.
NARROW = 12


def grams_of(cleaned: str, shortest: int = 3, longest: int = 5) -> Counter[str]:
    """How often a cleaned text has each n-gram, between boundary spaces; none of an empty text."""
    t = f" {cleaned} "
    return Counter(t[i : i + n] for n in range(shortest, longest + 1) for i in range(len(t) - n + 1)) if cleaned else Counter()


def bucket_of(gram: str) -> int:
    """One of 65,536 buckets: the first two bytes of the gram's MD5."""
    return int.from_bytes(hashlib.md5(gram.encode()).digest()[:2], "big")


def dealt(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, t)``: texts dealt over all cores, since they are small beside the work on them; a file's row groups may be few."""
    return text.dealt(df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")), "id")


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Ids and cleaned texts of a few rows at a time, of about ``size`` characters, so that what they grow into stays small."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), list(map(scan.ngram_text, batch.column(1).to_pylist()))
        lo = held = 0
        for at, t in enumerate(texts):
            if at > lo and (held + len(t) > size or at - lo >= rows):
                yield ids[lo:at], texts[lo:at]
                lo, held = at, 0
            held += len(t)
        if lo < len(ids):
            yield ids[lo:], texts[lo:]


#: Bits of a key: ``N`` characters of a batch's own alphabet, and a text's place in the batch.
KEY_BITS = 62


def _keyed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """``(owner, gram, n, grams)`` of cleaned texts, for 3-, 4- and 5-grams in turn: ``grams[gram[k]]`` is ``n[k]`` times in text ``owner[k]``.

    Characters are numbered within the batch, so that a gram is one number and
    doubles are found by sorting numbers; strings are made of distinct grams only.
    """
    padded = [f" {t} " if t else "" for t in texts]
    whole = "".join(padded)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    present = np.flatnonzero(np.bincount(codes, minlength=1))
    rank = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
    rank[present] = np.arange(len(present))
    bits, owner_bits = max(1, (len(present) - 1).bit_length()), (len(texts) - 1).bit_length()
    if 5 * bits + owner_bits > KEY_BITS:
        if len(texts) > 1:
            raise OverflowError
        for n in (3, 4, 5):
            counts = grams_of(texts[0], n, n)
            yield np.zeros(len(counts), np.int64), np.arange(len(counts)), np.fromiter(counts.values(), np.int64, len(counts)), list(counts)
        return
    char = rank[codes]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    of, left = np.repeat(np.arange(len(padded)), size), np.repeat(np.cumsum(size), size) - np.arange(len(char))
    letters = [chr(c) for c in present.tolist()]
    for n in (3, 4, 5):
        m = len(char) - n + 1
        if m < 1:
            continue
        key = of[:m] << (n * bits)
        for k in range(n):
            key |= char[k : k + m] << ((n - 1 - k) * bits)
        key, count = np.unique(key[left[:m] >= n], return_counts=True)
        distinct, gram = np.unique(key & ((1 << (n * bits)) - 1), return_inverse=True)
        columns = [[letters[c] for c in ((distinct >> (k * bits)) & ((1 << bits) - 1)).tolist()] for k in range(n - 1, -1, -1)]
        yield key >> (n * bits), gram, count, list(map("".join, zip(*columns)))


def _counted(texts: list[str]) -> Iterator[tuple[int, list]]:
    """``_keyed`` of as many texts at once as have an alphabet that fits, with the place of the first."""
    waiting = [(0, len(texts))]
    while waiting:
        lo, hi = waiting.pop()
        try:
            yield lo, list(_keyed(texts[lo:hi]))
        except OverflowError:
            waiting += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]


def gram_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, gram, n)`` of each row of ``df``."""

    def run(batches):
        for ids, texts in _parts(batches):
            own = pa.array(ids, pa.int64())
            for at, found in _counted(texts):
                for owner, gram, n, grams in found:
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(owner + at)), pa.array(grams, pa.string()).take(pa.array(gram)), pa.array(n)], names=["id", "gram", "n"])

    return dealt(df, id_col, text_col).mapInArrow(run, "id long, gram string, n long")


def _buckets(grams: list, known: dict, text_of=str) -> np.ndarray:
    """The buckets of distinct grams, which are texts or numbers that ``text_of`` reads."""
    if len(known) > KNOWN:
        known.clear()
    found = list(map(known.get, grams))
    if None in found:
        new = [g for g, bucket in zip(grams, found) if bucket is None]
        known.update(zip(new, map(bucket_of, map(text_of, new))))
        found = list(map(known.__getitem__, grams))
    return np.array(found, np.int32)


def _spelled(gram: int) -> str:
    return "".join(chr((gram >> shift) & ((1 << NARROW) - 1)) for shift in range(4 * NARROW, -1, -NARROW) if gram >> shift)


def _narrow_buckets(owners: list[int], texts: list[str], known: dict) -> Iterator[np.ndarray]:
    """``owner << 16 | bucket`` of every n-gram of narrow texts, at each of its places; a gram is one number, distinct ones are looked up.

    Owners are places in a batch, so that both fit 32 bits, which sort fastest."""
    padded = [f" {t} " for t in texts]
    char = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    of, left = np.repeat(np.array(owners, np.int32) << 16, size), np.repeat(np.cumsum(size), size) - np.arange(len(char))
    key = char[:-1] << NARROW | char[1:]
    for n in (3, 4, 5):
        m = len(char) - n + 1
        if m < 1:
            return
        key = key[:m] << NARROW | char[n - 1 :]
        inside = left[:m] >= n
        found = pa.array(key[inside]).dictionary_encode()
        yield of[:m][inside] | _buckets(found.dictionary.to_numpy().tolist(), known, _spelled)[found.indices.to_numpy()]


def _vectors(texts: list[str], known: dict = _known) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets in order, and their counts, of each text."""
    narrow = [k for k, t in enumerate(texts) if t and (t.isascii() or max(t) < chr(1 << NARROW))]
    keys = list(_narrow_buckets(narrow, [texts[k] for k in narrow], known)) if narrow else []
    others = texts if not narrow else texts.copy()
    for k in narrow:
        others[k] = ""
    if any(others):
        for at, found in _counted(others):
            keys += [np.repeat((owner + at).astype(np.int32) << 16 | _buckets(grams, known)[gram], n) for owner, gram, n, grams in found]
    key, n = np.unique(np.concatenate(keys or [np.empty(0, np.int32)]), return_counts=True)
    ends = np.searchsorted(key >> 16, np.arange(len(texts) + 1))
    return [(key[i:j] & 0xFFFF, n[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


def bucket_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, bucket, n)`` of each row of ``df``."""

    def run(batches):
        for ids, texts in _parts(batches):
            vectors = _vectors(texts)
            owner = np.repeat(np.arange(len(ids)), [len(b) for b, _ in vectors])
            bucket, n = (np.concatenate(c) for c in zip(*vectors))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(owner)), pa.array(bucket.astype(np.int32)), pa.array(n)], names=["id", "bucket", "n"])

    return dealt(df, id_col, text_col).mapInArrow(run, "id long, bucket int, n long")


def vectors_in(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Some ids of batches of ids and texts at a time, with their buckets in order and log-scaled counts 1 + ln(1 + n) as a vector of length 1; none of an empty text."""
    for ids, texts in _parts(batches):
        weighed = [(i, b, 1 + np.log1p(n)) for i, (b, n) in zip(ids, _vectors(texts)) if len(b)]
        yield [(i, b, w / np.sqrt((w * w).sum())) for i, b, w in weighed]


def unit_vectors(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, buckets, ws)`` of ``vectors_in``; no row of an empty text."""

    def run(batches):
        for vectors in vectors_in(batches):
            if vectors:
                ends = pa.array(np.concatenate(([0], np.cumsum([len(b) for _, b, _ in vectors]))), pa.int32())
                buckets = pa.array(np.concatenate([b for _, b, _ in vectors]).astype(np.int32))
                ws = pa.array(np.concatenate([w for _, _, w in vectors]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, _ in vectors], pa.int64()), pa.ListArray.from_arrays(ends, buckets), pa.ListArray.from_arrays(ends, ws)], names=["id", "buckets", "ws"]
                )

    return dealt(df, id_col, text_col).mapInArrow(run, "id long, buckets array<int>, ws array<double>")
