"""The features of an index's entries, in memory: which entries share what with an item.

The index is bounded, so it lies whole in every task: per feature the sorted
places of its entries. An item adds up or unites the lists of its features; no
row is made for a shared feature, only for what comes out.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scan, text
from . import features


def _keys(arrays: DataFrame, *more: str) -> DataFrame:
    """``(id, keys, ...)``: each feature as one text."""
    return arrays.select(F.col("id").cast("long").alias("id"), F.transform("features", lambda f: F.concat_ws("\x1f", f["label"], f["value"])).alias("keys"), *more)


def _weight(key: str) -> float:
    return features.WEIGHTS.get(key.split("\x1f", 1)[0], 1.0)


def _total(keys: list[str]) -> float:
    """Weights added one by one, as Spark does; ``sum`` makes up for lost digits, which shows where rounding ties."""
    return functools.reduce(operator.add, map(_weight, keys), 0.0)


class FeatureIndex:
    def __init__(self, rows: list[tuple[int, list[str]]]):
        rows = sorted(rows)
        self.pos = np.array([pos for pos, _ in rows], np.int64)
        self.total = np.array([sum(map(_weight, keys)) for _, keys in rows])
        held: dict[str, list[int]] = {}
        for place, (_, keys) in enumerate(rows):
            for key in keys:
                held.setdefault(key, []).append(place)
        self.places = {key: np.array(found, np.int64) for key, found in held.items()}

    def lists(self, keys: list[str]) -> list[tuple[str, np.ndarray]]:
        return [(k, self.places[k]) for k in keys if k in self.places]

    def shared(self, keys: list[str], most: int) -> np.ndarray:
        """Positions of the first ``most`` entries that share a feature, of all entries if none does."""
        found = self.lists(keys)
        if not found:
            return self.pos
        hit = np.zeros(len(self.pos), bool)
        for _, places in found:
            hit[places] = True
        return self.pos[np.flatnonzero(hit)[:most]]

    def jaccards(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.lists(keys)
        if not found:
            return self.pos[:0], self.total[:0]
        common = np.zeros(len(self.pos))
        for key, places in found:
            common[places] += _weight(key)
        hit = np.flatnonzero(common > 0)
        union = self.total[hit] + sum(map(_weight, keys)) - common[hit]
        return self.pos[hit], common[hit] / union


def _broadcast(entries: DataFrame):
    rows = [(r["id"], r["keys"]) for r in _keys(entries).collect()]  # an index, whose size the caller checks
    return entries.sparkSession.sparkContext.broadcast(FeatureIndex(rows))


def _batch(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else []
    if columns and len(columns[0]):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


#: Rows that a task holds before it gives them on.
ROWS = 1 << 20


def _each(items: DataFrame, entries: DataFrame, of, schema: str) -> DataFrame:
    """Rows of ``of(index, keys)`` for every text of ``items(id, text)``, its id first; its keys are used where it is read."""
    index = _broadcast(entries)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for ident, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = of(index.value, [f"{label}\x1f{v}" for label, values in zip(scan.LABELS, scan.features(t)) for v in values])
                parts.append((np.full(len(found[0]), ident, np.int64), *found))
                size += len(found[0])
                if size >= ROWS:
                    yield from _batch(parts, names)
                    parts, size = [], 0
        yield from _batch(parts, names)

    return text.dealt(items.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t")), "id").mapInArrow(run, schema)


def candidates(items: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    return _each(items, entries, lambda index, keys: (index.shared(keys, most),), "id long, pos long")


def among_candidates(pairs: DataFrame, items: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    """Those of ``pairs(id, pos, ...)`` that are candidates; an item's are asked together, and are no more than the index has entries."""
    others = [c for c in pairs.columns if c != "id"]
    asked = pairs.groupBy("id").agg(F.collect_list(F.struct(*others)).alias("asked"))
    held = _keys(items.join(asked, "id"), "asked")
    index = _broadcast(entries)

    def run(batches):
        for batch in batches:
            asked, flags = batch.column(2), []
            for i, keys in enumerate(batch.column(1).to_pylist()):
                flags.append(np.isin(asked[i].values.field("pos").to_numpy(), index.value.shared(keys, most)))
            sizes = np.concatenate(([0], np.cumsum([len(f) for f in flags]))).astype(np.int32)
            ok = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(flags) if flags else np.empty(0, bool)))
            yield pa.RecordBatch.from_arrays([batch.column(0), asked, ok], names=["id", "asked", "ok"])

    judged = held.mapInArrow(run, held.drop("keys").schema.add("ok", T.ArrayType(T.BooleanType())))
    each = F.zip_with("asked", "ok", lambda a, ok: F.struct(a.alias("a"), ok.alias("ok")))
    return judged.select("id", F.explode(F.filter(each, lambda x: x["ok"])).alias("x")).select("id", "x.a.*").select(pairs.columns)


def compared(pairs: DataFrame, items: DataFrame, entries: DataFrame) -> DataFrame:
    """``pairs(id, pos, ...)`` with ``sig``, ``shared_key``, ``events`` and ``other_dates``, see ``similarity.compared``; an item's pairs are asked together."""
    others = [c for c in pairs.columns if c != "id"]
    asked = pairs.groupBy("id").agg(F.collect_list(F.struct(*others)).alias("asked"))
    semantic = F.filter("features", lambda f: f["label"] == "SEMANTIC")
    facts = F.exists(semantic, lambda f: features.is_event(f["value"])).alias("event"), F.exists("features", lambda f: f["label"] == "ISO_DATE").alias("dated")
    rows = sorted((r["id"], r["keys"], r["event"], r["dated"]) for r in _keys(entries, *facts).collect())
    index = FeatureIndex([row[:2] for row in rows]), np.array([row[2] for row in rows], bool), np.array([row[3] for row in rows], bool), np.array([_total(row[1]) for row in rows])
    broadcast = entries.sparkSession.sparkContext.broadcast(index)
    found = ["sig double", "shared_key boolean", "events boolean", "other_dates boolean"]

    def run(batches):
        index, events, dated, total = broadcast.value
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            parts = []
            for keys, event, dates, asked in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), batch.column(4)):
                common, key, date = np.zeros(len(index.pos)), np.zeros(len(index.pos), bool), np.zeros(len(index.pos), bool)
                for k, places in index.lists(keys):
                    common[places] += _weight(k)
                    label = k.split("\x1f", 1)[0]
                    if label == "ISO_DATE":
                        date[places] = True
                    elif label in features.KEY_LABELS:
                        key[places] = True
                at = np.searchsorted(index.pos, asked.values.field("pos").to_numpy())
                union = _total(keys) + total[at] - common[at]
                sig = np.divide(common[at], union, out=np.zeros(len(at)), where=union > 1e-9)
                parts.append((sig, key[at], event & events[at], dates & dated[at] & ~date[at]))
            if parts:
                flat, sizes = batch.column(4).flatten(), [len(p[0]) for p in parts]
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
                new = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([ids, *flat.flatten(), *new], names=["id", *others, *(f.split()[0] for f in found)])

    schema = T.StructType([pairs.schema["id"], *(pairs.schema[c] for c in others)])
    for f in found:
        schema = schema.add(*f.split())
    held = _keys(items.join(asked, "id"), *facts, "asked")
    schema.fields[0] = T.StructField("id", T.LongType())
    return held.mapInArrow(run, schema)


def jaccards(items: DataFrame, entries: DataFrame) -> DataFrame:
    return _each(items, entries, lambda index, keys: index.jaccards(keys), "id long, pos long, sig double")
