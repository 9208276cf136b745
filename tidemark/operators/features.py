"""Signatures and n-gram vectors of short texts, in long form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scan, text

# Weights of feature labels; others weigh 1.
WEIGHTS = {
    "PERSON": 2.0, "ORG": 2.2, "GPE": 0.9, "LOC": 1.6, "FAC": 1.4, "EVENT": 2.8, "LAW": 1.8, "PRODUCT": 1.2, "WORK": 1.0, "DATE": 1.2, "TIME": 0.8,
    "MONEY": 0.8, "PERCENT": 0.6, "QUANTITY": 0.6, "ORDINAL": 0.4, "CARDINAL": 0.4, "NUM": 0.7, "TW": 0.7, "DOMAIN": 1.0, "URL": 0.4, "ISO_DATE": 0.7,
    "YEAR": 0.6, "SEMANTIC": 1.3, "SCRIPT": 0.0,
}
# Entity labels that change their name; the others keep it.
ENTITY_LABELS = {"WORK_OF_ART": "WORK", "MISC": "ORG"}
KEY_LABELS = ("PERSON", "ORG", "EVENT", "LAW")
# Tokens that mark a text as about an event.
EVENT_WORDS = (
    "protest", "protests", "demonstration", "rally", "unrest", "uprising", "riot", "clash", "crackdown", "violence", "death", "deaths", "killed",
    "executed", "casualties", "fatalities", "blackout", "shutdown", "censorship", "blocked", "disrupted", "internet", "sanctions", "embargo", "crisis",
    "conflict", "war", "activist", "rights", "freedom", "primary_protest", "primary_violence", "primary_death", "primary_internet", "primary_regime",
)
EVENT_FAMILIES = ("protest", "violence", "death", "internet", "regime", "sanctions")

#: A source of named entities: (texts) -> array<struct<label, text>> column.
EntityExtractor = Callable[[Column], Column]


def label_of(entity_label: Column) -> Column:
    renamed = F.create_map(*[F.lit(x) for kv in ENTITY_LABELS.items() for x in kv])
    return F.coalesce(renamed[entity_label], entity_label)


def weight(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return F.coalesce(table[label], F.lit(1.0))


PAIRS = T.ArrayType(T.StructType().add("label", "string").add("value", "string"))


def signature_arrays(df: DataFrame, id_col: str, text_col: str, entities: EntityExtractor | None = None) -> DataFrame:
    """``(id, features)``: each text's distinct ``(label, value)`` pairs as one array.

    Entity values of two characters or fewer do not count.
    """
    dealt = text.dealt(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")), "id")
    if entities is not None:
        kept = F.filter(entities(text.strip_retweet(F.col("t"))), lambda e: F.length(F.trim(e["text"])) > 2)
        dealt = dealt.withColumn("own", F.array_distinct(F.transform(kept, lambda e: F.struct(label_of(e["label"]).alias("label"), F.lower(F.trim(e["text"])).alias("value")))))
    found = dealt.drop("t").schema.add("features", PAIRS)
    at = dealt.columns.index("t")

    def run(batches):
        for batch in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            every = [scan.features(t) for t in batch.column(at).to_pylist()]
            sizes = np.array([[len(values) for values in own] for own in every]).reshape(-1, len(scan.LABELS))
            labels = pa.array(scan.LABELS).take(pa.array(np.repeat(np.tile(np.arange(len(scan.LABELS)), len(every)), sizes.ravel())))
            values = pa.array([v for own in every for values in own for v in values], pa.string())
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes.sum(1)))), pa.int32())
            pairs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([labels, values], names=["label", "value"]))
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), pairs], names=found.names)

    arrays = dealt.mapInArrow(run, found)
    return arrays if entities is None else arrays.select("id", F.concat("features", F.array_except("own", "features")).alias("features"))


def signature(df: DataFrame, id_col: str, text_col: str, entities: EntityExtractor | None = None) -> DataFrame:
    """``(id, label, value)``, each once for each row of ``df``."""
    return feature_rows(signature_arrays(df, id_col, text_col, entities))


def feature_rows(arrays: DataFrame) -> DataFrame:
    """``(id, label, value)`` of signature arrays.

    Not ``explode``: Spark would ask first whether the array is empty, and for
    that compute the whole signature once more for each use of its parts.
    """
    return arrays.select("id", F.explode_outer("features").alias("f")).filter("f IS NOT NULL").select("id", "f.label", "f.value")


def is_event(semantic_value: Column) -> Column:
    """Whether a SEMANTIC value marks an event."""
    family, word = F.split_part(semantic_value, F.lit(":"), F.lit(1)), F.split_part(semantic_value, F.lit(":"), F.lit(2))
    return semantic_value.isin(*EVENT_WORDS) | (semantic_value.contains(":") & (family.isin(*EVENT_FAMILIES) | word.isin(*EVENT_WORDS)))
