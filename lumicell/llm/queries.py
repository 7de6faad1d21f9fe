"""The registered queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicell.llm import decontam, mixing, nsbounds, permindex, pii, pseudolm, runs, sharding, simhash, substrings, toolcalls, toxicity, warc
from lumicell.llm.shared import read_table


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.calls_of_conversations(read_table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, toolcalls.SCHEMAS)


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudolm.train_and_score(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, read_table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(read_table(spark, sf_dir, "documents")))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permindex.nearest(read_table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find(runs.periodic(read_table(spark, sf_dir, "documents"))))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nsbounds.cluster(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mixing": mixing.MIX_SQL.format(documents="documents"),
        "op10_warc": warc.ROUND_TRIP_SQL,
        "op12_substrings": substrings.REMOVE_SQL,
        "op13_ns_bounds": nsbounds.CLUSTER_SQL,
    }
