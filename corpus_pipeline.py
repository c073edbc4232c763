"""The corpus pipeline: documents pass five stages, each written as Parquet and read again by the next.

Every stage works on whole texts and takes any further columns along, whatever their names. Null and empty texts have no
words, so the first stage rejects them; rows with null ids are judged like others, but lose no passages and name no
group. Of rows that repeat, or of one id with several texts, each row has its own fate, and the second stage keeps one of
each group. Ties follow the operators' order. From an empty table every stage makes an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sitescope.llm import common, jaccard, packing, quality, secrets, substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, common.read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, 5, 80, 100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; texts that lose none stay as they are."""
    return substrings.without_repeats(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("packing", pack_sequences),
]

#: No stage is expressible in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. A stage's files are deleted when the next has read them."""
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            common.remove(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)
