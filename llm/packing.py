"""Operator 8, best-fit packing: large-item matching.

A document's pieces are known to the packer by length only, so the packing is
planned on the histogram of lengths: pieces above a third of the capacity are
matched in pairs, the longest first with the longest partner that fits, and
shorter ones best-fit the gaps. The plan says which ranks of each length go to
which sequences; a global order of the pieces turns ranks into rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .order import place_rows
from .subwords import default_vocabulary, encode_batch, slices


def pieces(
    docs: DataFrame, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``; only documents over ``capacity`` are cut."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                ids, offsets = encode_batch(batch.column(1), path)
                out = []
                for doc, a, b in zip(batch.column(0).to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    n = len(own)
                    count = -(-n // capacity)
                    first = n - capacity * (count - 1)
                    for k in range(count):
                        lo = first + capacity * (k - 1) if k else 0
                        hi = first + capacity * k
                        out.append((doc, k, lo, hi - lo, zlib.crc32(own[lo:hi].tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Plan:
    """Groups of bins filled alike, by the gap that is left in them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_gap: dict[int, list[tuple[int, tuple]]] = defaultdict(list)

    def add(self, bins: int, content: tuple) -> None:
        if bins:
            gap = self.capacity - sum(length * copies for length, copies in content)
            self.by_gap[gap].append((bins, content))

    def take(self, gap: int) -> tuple[int, tuple]:
        group = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap]
        return group


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """``(bins, ((length, copies), ...))`` groups that hold every piece of the histogram."""
    left = {length: n for length, n in histogram.items() if n}
    plan = _Plan(capacity)
    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for length in large:
        while left[length]:
            n = left[length]
            partner = next((x for x in large if x <= length and x + length <= capacity and left[x] > (x == length)), None)
            if partner is None:
                plan.add(n, ((length, 1),))
                left[length] = 0
            elif partner == length:
                plan.add(n // 2, ((length, 2),))
                left[length] = n % 2
            else:
                pairs = min(n, left[partner])
                plan.add(pairs, ((length, 1), (partner, 1)))
                left[length] -= pairs
                left[partner] -= pairs
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[length]
        while n:
            gap = min((g for g in plan.by_gap if g >= length), default=capacity)
            fits = gap // length
            bins, content = plan.take(gap) if gap in plan.by_gap else (-(-n // fits), ())
            full = min(bins, n // fits)
            plan.add(full, (*content, (length, fits)))
            n -= full * fits
            bins -= full
            if bins and n:  # fewer than a gap's worth are left
                plan.add(1, (*content, (length, n)))
                n = 0
                bins -= 1
            if content:
                plan.add(bins, content)
    return [group for gap in sorted(plan.by_gap) for group in plan.by_gap[gap]]


def _slots(groups: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, rank from, rank before, first sequence, offset)`` of every slot of every group."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for bins, content in groups:
        offset = 0
        for length, copies in content:
            for _ in range(copies):
                out.append((length, used[length], used[length] + bins, sequence, offset))
                used[length] += bins
                offset += length
        sequence += bins
    return out


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its subword ids and ``end_id``. What the driver holds is the
    histogram of lengths and its plan, at most ``capacity`` lengths however
    many pieces there are. Defined results: null and empty texts are the end id
    alone; documents over ``capacity`` ids are cut so that only the first piece
    may be shorter; repeated rows are packed each; null ids are kept; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, end_id, id_col, text_col, vocabulary), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = spark.createDataFrame(_slots(plan_bins(histogram, capacity)), "slot_length long, low long, high long, sequence long, offset long")
    firsts, seen = [], 0
    for length in sorted(histogram):
        firsts.append((length, seen))
        seen += histogram[length]
    first = spark.createDataFrame(firsts, "of_length long, first long")
    ranked = (
        place_rows(cut, ["length", "doc_id", "piece"], "pack-order")
        .join(F.broadcast(first), F.col("length") == F.col("of_length"))
        .withColumn("rank", F.col("place") - F.col("first"))
    )
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(F.broadcast(slots), here).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"
    )
