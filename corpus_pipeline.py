"""The training-data pipeline: five stages over the documents table, each written before the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Stages decide for themselves on all that their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import bpe, common, exact_dedup, langid, mixture, near_dup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language the network cannot tell, go."""
    return langid.recognised(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest stays."""
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a near-duplicate group, the document with the smallest doc_id stays."""
    return near_dup.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand in the mix as often as their source's quota takes them."""
    return mixture.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return bpe.bpe_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dup", near),
    ("mix_sources", mix),
    ("bpe", encode),
]

#: A trained network and merges by rank are not expressible; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = common.new_path(spark, f"pipeline-{name}")
        docs = common.written(stage(spark, docs, sf_dir), name, path)
        if before is not None:
            common.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
