"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``docs``.

1. language: drops documents that resemble no learned language (null text, no letter, no language's n-grams).
2. near_duplicates: keeps one document of every class of near duplicates.
3. decontamination: drops documents that contain a benchmark item.
4. mixing: repeats or drops documents so that the sources meet their target weights.
5. sharding: puts every record into one of ``SHARDS`` shards by rendezvous hashing of its doc_id.

Nulls in any column, empty tables, repeated rows and extra columns are handled
as the operators' docstrings define; extra columns pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmur.llm import decontaminate, langid, minhash, mixing, sharding
from murmur.llm.common import scratch_path, ship, table

SHARDS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, "doc_id", [1.0] * SHARDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

# Language, near duplicates and decontamination are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last one."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{k}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
