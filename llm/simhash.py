"""Operator 10, SimHash near-dedup: deletion-variant signatures.

A fingerprint is cut into so few segments that two fingerprints within the
bound share a segment up to one bit. Every segment is indexed with each of its
bits wildcarded in turn; equal variants meet in a shuffle and are verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, utf8, with_found
from .components import connected_components

#: Variants of one bucket that are compared with each other; larger buckets
#: are cut by pieces of the bits they leave free.
BUCKET = 1024
#: Fingerprints of a chunk; two chunks of what is still larger meet in a task.
CHUNK = 8192


def _fingerprint(body: bytes, words: int) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    w = body.lower().split()  # on bytes: A-Z only, and exactly space and \x09-\x0D
    n = len(w)
    if not n:
        return 0
    joined = b" ".join(w)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return print_of(np.array([digest(joined[i:j], 42) for i, j in zip(starts, ends[words - 1 :].tolist())], np.uint64))


def print_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of hashes: bits set in over half of them; zero of none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint's bits held in a signed long.

    Words are runs of anything but space and ``\\x09-\\x0D``, A-Z lowered. A text
    of fewer words is one shingle; one without words (null too) has zero.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))

    def run(batches):
        for batch in batches:
            seen: dict[bytes, int] = {}
            out = []
            for body in batch.column(1).to_pylist():
                if body not in seen:
                    seen[body] = _fingerprint(body, words)
                out.append(seen[body])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return rows.mapInArrow(run, "doc_id long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """The fewest segments of which one has at most one of ``max_bits`` differences."""
    n = max_bits // 2 + 1
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _links_in_runs(keys: np.ndarray, fps: np.ndarray, max_bits: int):
    """Pairs of neighbours-by-key within ``max_bits``, for keys in sorted order."""
    found = []
    at = np.arange(len(keys))
    step = 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        close = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits]
        if len(close):
            found.append((close, close + step))
        step += 1
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each index's component, over links between ``n`` of them."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _narrower(mask: int, max_bits: int) -> list[int]:
    """Masks that fix one more of ``max_bits + 1`` pieces of the bits that ``mask`` leaves free."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    cuts = [round(len(free) * i / (max_bits + 1)) for i in range(max_bits + 2)]
    return [mask | sum(1 << bit for bit in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _spanning(k: np.ndarray, f: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of each run of equal ``k``."""
    a, b = _links_in_runs(k, f, max_bits)
    used, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = used[_roots(inverse[: len(a)], inverse[len(a) :], len(used))] if len(a) else used
    away = root != used
    return f[used[away]], f[root[away]]


def _compare(buckets: DataFrame, max_bits: int, most: int | None) -> DataFrame:
    """Spanning links ``(a, b, false)`` of each bucket of ``buckets(key, mask, fp)``, whose rows are distinct.

    The rows of a bucket over ``most`` are given once for each narrower mask
    instead, as ``(mask, fp, true)``, while they stream by: a task holds no
    more than ``most`` rows of a bucket besides one batch.
    """
    parts = shuffle_partitions(buckets.sparkSession)

    def batch_of(a, b, large):
        columns = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), large))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "large"])

    def run(batches):
        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)]
        splitting: set[tuple[int, int]] = set()  # (key, mask) of open buckets over ``most``

        def work(k, m, f, last):
            nonlocal held, splitting
            order = np.lexsort((m, k))
            k, m, f = k[order], m[order], f[order]
            starts = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (m[1:] != m[:-1]))))
            ends = np.append(starts[1:], len(k))
            large = ends - starts > most if most is not None else np.zeros(len(starts), bool)
            for key, mask in splitting:
                large |= (k[starts] == key) & (m[starts] == mask)
            small = np.ones(len(k), bool)
            for lo, hi in zip(starts[large].tolist(), ends[large].tolist()):
                for narrow in _narrower(int(m[lo]), max_bits):
                    yield batch_of(np.full(hi - lo, narrow, np.uint64), f[lo:hi], True)
                small[lo:hi] = False
            splitting = {(int(k[i]), int(m[i])) for i in starts[large] if k[i] == k[-1]}
            open_at = len(k) if last else int(np.searchsorted(k, k[-1]))  # buckets of the last key may go on
            done = small & (np.arange(len(k)) < open_at)
            a, b = _spanning(np.repeat(np.arange(len(starts)), ends - starts)[done], f[done], max_bits)
            if len(a):
                yield batch_of(a, b, False)
            rest = small & ~done
            held = [k[rest], m[rest], f[rest]]

        for batch in batches:
            new = [batch.column(0).to_numpy(), *(batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))]
            yield from work(*(np.concatenate(both) for both in zip(held, new)), False)
        if len(held[0]):
            yield from work(*held, True)

    return buckets.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, large boolean")


def _blocks(buckets: DataFrame, chunk: int) -> DataFrame:
    """``(key, mask, fp)`` of the same buckets, those over ``chunk`` rows cut into chunks that meet pairwise."""
    sizes = buckets.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), F.count("*").alias("rows"))
    sized = with_found(buckets, materialize(sizes, "simhash-sizes"), ["key"], "rows")
    own = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("chunks")).cast("int")
    met = sized.select("key", "mask", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    return met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "mask", "fp")


def fingerprint_links(distinct: DataFrame, max_bits: int = 4, most: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints of ``distinct(fp)``.

    Enough links are returned to connect everything within ``max_bits`` of each
    other: each bucket gives a spanning forest, not all its pairs. A bucket over
    ``most`` rows is cut once more by the ``max_bits + 1`` pieces of the bits
    that its mask leaves free, of which one is equal in any linked pair. What
    is over ``chunk`` rows then holds fingerprints that are alike; it is cut
    into chunks that meet pairwise, so no task compares a whole one.
    """
    masks = [((1 << hi) - (1 << lo)) ^ (1 << bit) for lo, hi in segments(max_bits) for bit in range(lo, hi)]
    key = F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key")
    variants = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    first = materialize(_compare(variants.select(key, "mask", "fp"), max_bits, most), "simhash-links")
    links = first.filter("not large").select("a", "b")
    large = first.filter("large").select(F.col("a").alias("mask"), F.col("b").alias("fp"))
    if not large.isEmpty():
        again = materialize(large.distinct().select(key, "mask", "fp"), "simhash-large")
        links = links.union(_compare(_blocks(again, chunk), max_bits, None).select("a", "b"))
    return links.distinct()


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4
) -> DataFrame:
    """Per document: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Documents link when their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest id reachable. Defined results: null and
    empty texts have fingerprint zero and link like any other; repeated rows
    are returned each; null ids are never a component's smallest unless it has
    no other; an empty table gives an empty result; extra columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "simhash-distinct")
    links = materialize(fingerprint_links(distinct, max_bits), "simhash-edges")
    labels = connected_components(links)
    named = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", "first_id", "rows", F.coalesce("label", "fp").alias("label")
    )
    named = materialize(named, "simhash-named")
    smallest = materialize(named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("prints")), "simhash-smallest")
    per_print = materialize(with_found(named, smallest, ["label"], "prints").select("fp", "rows", "component_id"), "simhash-components")
    return with_found(prints, per_print, ["fp"], "rows").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
