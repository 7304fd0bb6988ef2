"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, mixing.

Each stage takes the rows its predecessor kept and decides about all of them. All
but the last return the columns of ``documents``; the last returns the mix, a row for
each piece taken, with its shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshweave.llm import common, decontaminate, mixing, pii, quality, simhash


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that importance resampling does not draw."""
    return quality.Selector(docs, common.read(spark, sf_dir, "labels")).select(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies: SimHash within 2 bits, or similarity 0.8 over five words."""
    return simhash.one_of_each_class(docs, radius=2)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the mix of the sources, in shards."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", select_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
]

#: Learned models, components and random draws are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
