"""The corpus pipeline: toxicity, exact copies, near copies, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import decontaminate, exact_dedup, near_copies as near, packing, toxicity
from llm.common import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.3 or more; learns from all labelled documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3, held_out=None)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z keep the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a five-word Jaccard similarity of 0.8 or more keep the smallest doc_id."""
    return near.drop_near_copies(docs, words=5, share=(4, 5), max_bits=4)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 subword ids."""
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("best_fit_packing", packed),
]

#: The model, the shingles and the packing are beyond SQL; tests compare the
#: copy stages and the packing with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
