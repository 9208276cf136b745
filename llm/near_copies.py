"""Near copies by the Jaccard similarity of word shingles, for the pipeline.

SimHash fingerprints within a few bits of each other (deletion variants, as in
``simhash``) and MinHash bands, for the similar texts whose fingerprints lie
farther apart, find candidates. Their groups are then compared exactly: every
text is sent to its group once, and large groups are cut into chunks that meet
pairwise, so no task holds a whole one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import materialize, shuffle_partitions, utf8, with_found
from .components import connected_components
from .simhash import _roots, fingerprint_links, print_of

#: Bands of so many minima. Two sets of Jaccard 0.8 share none of the bands
#: with probability (1 - 0.8**6)**42 = 3e-6.
BANDS, ROWS = 42, 6
#: Texts and bytes of a chunk; two chunks meet in a task.
CHUNK_ROWS, CHUNK_BYTES = 512, 2 << 20

_rng = np.random.default_rng(5)
_FACTOR = _rng.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _rng.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_MIX = _rng.integers(1 << 63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(body: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; words as in ``simhash``."""
    w = body.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], 42) for i, j in zip(starts, ends[words - 1 :].tolist())], np.uint64))


def _band_keys(shingles: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(low, (shingles[None, at : at + 256] * _FACTOR[:, None] + _TERM[:, None]).min(1), out=low)
    return (low.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64).view(np.int64)


def _digest(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7)


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(doc_id, row, digest, print, keys, n)``, a written table: texts of equal shingle sets have
    equal digests, ``print`` is their SimHash, ``row`` has all columns of ``docs`` and ``n`` tells rows apart."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                texts = pc.fill_null(part.column(1).field(text_col).cast(pa.string()), "").cast(pa.binary())
                sets = [shingle_set(body, words) for body in texts.to_pylist()]
                digests = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
                prints = np.array([print_of(s) for s in sets], np.uint64).view(np.int64)
                keys = np.concatenate([_band_keys(s) for s in sets])
                offsets = pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digests), pa.array(prints), pa.ListArray.from_arrays(offsets, pa.array(keys))],
                    names=["doc_id", "row", "digest", "print", "keys"],
                )

    schema = StructType([*rows.schema.fields, StructField("digest", LongType()), StructField("print", LongType()), StructField("keys", ArrayType(LongType()))])
    return materialize(rows.mapInArrow(run, schema).withColumn("n", F.monotonically_increasing_id()), "near-sets")


def similar_pairs(sets: list[np.ndarray], share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of sets whose Jaccard similarity is at least ``share[0] / share[1]``."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    owner, flat = np.repeat(np.arange(n), sizes.astype(np.int64)), np.concatenate(sets)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    use = shared[column]
    owner, column = owner[use], (np.cumsum(shared) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float64)
    width = 2048
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        tile = np.zeros((n, min(width, int(shared.sum()) - at)), np.float32)  # counts under 2**24 are exact
        tile[owner[lo:hi], column[lo:hi] - at] = 1
        common += tile @ tile.T
    a, b = np.nonzero(np.triu(share[1] * common >= share[0] * (sizes[:, None] + sizes[None, :] - common), 1))
    return a, b


def _verified(blocks: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Links ``(a, b)`` that connect all similar texts of each ``(label, lo, hi)``."""
    parts = shuffle_partitions(blocks.sparkSession)

    def links(bodies: list[bytes]):
        sets = [shingle_set(body, words) for body in bodies]
        node = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
        a, b = similar_pairs(sets, share)
        root = _roots(a, b, len(sets))
        away = root != np.arange(len(sets))
        return pa.RecordBatch.from_arrays([pa.array(node[away]), pa.array(node[root[away]])], names=["a", "b"])

    def run(batches):
        key, bodies = None, []
        for batch in batches:
            for *block, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if block != key:
                    if len(bodies) > 1:
                        yield links(bodies)
                    key, bodies = block, []
                bodies.append(body)
        if len(bodies) > 1:
            yield links(bodies)

    keys = ("label", "lo", "hi")
    return blocks.select(*keys, "body").repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _hooked(met: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect what ``met(digest, a)`` does, a row per shared key.

    A text has a smallest text for each of its keys. It is linked with the
    smallest of these only, and these with it: they are the same few for all
    texts of a large group, so its links grow with its texts, not with texts times keys.
    """
    own = Window.partitionBy("digest")  # a row for each band at most
    hooked = materialize(met.select("digest", "a", F.min("a").over(own).alias("head")).distinct(), "near-hooked")
    links = hooked.select(F.col("head").alias("a"), F.col("digest").alias("b")).union(hooked.select("head", "a"))
    return links.filter("a <> b").distinct()


def _by_print(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links ``(a, b)`` that connect all of ``distinct(digest, print)`` whose fingerprints differ in at most ``max_bits`` bits."""
    prints = materialize(distinct.groupBy("print").agg(F.min("digest").alias("head"), F.count("*").alias("digests")), "near-prints")
    near = materialize(fingerprint_links(prints.select(F.col("print").alias("fp")), max_bits), "near-print-links")
    headed = lambda c: prints.select(F.col("print").alias(c), F.col("head").alias(f"head_{c}"))
    apart = near.join(headed("a"), "a").join(headed("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    equal = with_found(distinct.select("digest", "print"), prints, ["print"], "digests").select(F.col("head").alias("a"), F.col("digest").alias("b"))
    return apart.union(equal.filter("a <> b"))


def _grouped(sets: DataFrame, text_col: str, words: int, share: tuple[int, int], max_bits: int) -> DataFrame:
    """``(digest, component_id, keeper)``: a group's smallest id, and the row number of one row that has it."""
    distinct = sets.groupBy("digest").agg(F.first("print").alias("print"), F.first("keys").alias("keys"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n")).alias("first"))
    distinct = materialize(distinct, "near-distinct")
    entries = distinct.select("digest", F.posexplode("keys").alias("band", "key")).select("digest", F.xxhash64("band", "key").alias("key"))
    # minima and counts are combined before they are shuffled, so a key that many texts share is no task's alone
    shared = entries.groupBy("key").agg(F.min("digest").alias("a"), F.count("*").alias("digests")).filter("digests > 1")
    met = with_found(entries, materialize(shared, "near-shared"), ["key"], "digests")
    linked = _hooked(met.filter("a IS NOT NULL").select("digest", "a")).union(_by_print(distinct.select("digest", "print"), max_bits))
    candidates = connected_components(materialize(linked, "near-candidates"))

    # each candidate's text comes from its first row
    firsts = distinct.select(F.col("first.n").alias("first_n"), "digest").join(candidates, F.col("digest") == candidates.node).select("first_n", "label")
    members = sets.join(firsts, sets.n == firsts.first_n).select("digest", "label", utf8(f"row.{text_col}").alias("body"))
    members = materialize(members, "near-members")
    sizes = members.groupBy("label").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum(F.length("body")) / CHUNK_BYTES)).cast("int").alias("chunks"), F.count("*").alias("texts")
    )
    own = F.pmod(F.xxhash64(F.lit("chunk"), "digest"), F.col("chunks")).cast("int")
    sized = with_found(members, materialize(sizes, "near-sizes"), ["label"], "texts")
    blocks = sized.select("label", "body", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    blocks = blocks.select("label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "body")
    links = materialize(_verified(blocks, words, share), "near-links")

    labels = connected_components(links)
    named = distinct.join(labels, distinct.digest == labels.node, "left").select("digest", "first", F.coalesce("label", "digest").alias("label"))
    named = materialize(named, "near-named")
    smallest = named.groupBy("label").agg(F.min("first").alias("least"), F.count("*").alias("digests"))
    per_set = with_found(named.select("label", "digest"), materialize(smallest, "near-smallest"), ["label"], "digests")
    return per_set.select("digest", F.col("least.doc_id").alias("component_id"), F.col("least.n").alias("keeper"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (4, 5), max_bits: int = 4
) -> DataFrame:
    """Per document ``doc_id`` and ``component_id``, the smallest id reachable.

    Documents link when the sets of their ``words``-word shingles have a
    Jaccard similarity of at least ``share[0] / share[1]``; a text of fewer
    words is one shingle. Every link is verified on whole texts. None is missed
    whose fingerprints differ in at most ``max_bits`` bits; that any other is,
    see BANDS, is as unlikely as stated there. Defined results: texts
    without words (null too) are equal; repeated rows are returned each; null
    ids are never a component's smallest unless it has no other; an empty
    table gives an empty result; other columns are ignored.
    """
    sets = _sets(docs, id_col, text_col, words)
    per_set = materialize(_grouped(sets, text_col, words, share, max_bits), "near-components")
    counts = sets.groupBy("digest").agg(F.count("*").alias("rows"))
    found = materialize(per_set.join(counts, "digest"), "near-found")
    return with_found(sets.select("doc_id", "digest"), found, ["digest"], "rows").select("doc_id", "component_id")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (4, 5), max_bits: int = 4
) -> DataFrame:
    """One row of ``docs`` for each group of ``near_groups``, columns unchanged.

    It has the group's smallest id, or no id if none has; of several such rows
    any one stays.
    """
    sets = _sets(docs, id_col, text_col, words)
    keepers = _grouped(sets, text_col, words, share, max_bits).select("keeper").distinct()
    return sets.join(keepers, sets.n == keepers.keeper, "left_semi").select("row.*")
