"""A corpus preparation pipeline: five stages, each written as Parquet and read again as the next one's documents.

All stages take documents with nulls in any column, empty and very long texts, rows without an id, repeated rows and further columns of
any name; the first four return the columns they are given.  No documents give no documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumicell.llm import decontam, mixing, sharding, simhash, toxicity
from lumicell.llm.shared import read_table, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on the labelled ones does not reject.

    A null or empty text has the model's base score, so it stays; without labels, or with clean ones only, nothing is rejected.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group, that with the smallest id (a row without an id only where the group has no other).

    Texts without words form one group; of rows with that id the one with the smallest hashes of text and other columns stays.
    """
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; null and empty texts hold none, a benchmark without words takes nothing out."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are not taken.  A null source is a source of its own."""
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row of the mix; rows equal in id and text are interchangeable."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The first stage trains a model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what lies between them is in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
