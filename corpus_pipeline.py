"""A training corpus in five stages, from raw documents to packed bins.

Every stage reads what its predecessor kept, written as Parquet in between, so a lost executor repeats at
most one stage. All stages but the last return the columns of ``documents``.

Defined cases, stage by stage: a NULL text counts as the empty one everywhere and is kept (the empty texts as one group
of copies, of which the least id stays); rows with a NULL doc_id are never dropped as copies or for a benchmark
item; repeated rows are copies; further columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, packing, pii, simhash, toxicity
from millrace.llm.common import read_table, remove
from millrace.session import scratch_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labels of its training rows only."""
    labels = read_table(spark, sf_dir, "labels").where(toxicity.training())
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of every group of near copies: SimHash over 3-word shingles, linked at 2 or fewer bits."""
    return simhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.mask_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of fixed capacity."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]

# SQL cannot express the trained stages; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's table is removed once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
