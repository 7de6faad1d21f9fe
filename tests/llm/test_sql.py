"""Corpus queries that SQL can express, against DuckDB on the smallest tables; and that all are registered."""

import re

import duckdb
import pytest

import __spark_entry__
from lumicell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    database = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        database.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    relation = database.sql(queries.oracle_sql()[name])
    columns = list(relation.columns)
    frame = queries.queries()[name](spark, small)
    assert sorted(frame.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted((tuple(r[c] for c in order) for r in frame.collect()), key=repr) == sorted((tuple(r[columns.index(c)] for c in order) for r in relation.fetchall()), key=repr)


def test_one_query_for_each_operator():
    names = __spark_entry__.queries()
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name,columns", [
    ("op3_toxicity", ["doc_id", "held_out", "score", "predicted"]), ("op5_simhash", ["doc_id", "fingerprint", "component_id"]), ("op6_mixing", ["doc_id", "size", "source_size", "target", "taken"]),
    ("op7_sharding", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]), ("op8_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]),
    ("op9_permutation_index", ["query_id", "rank", "vec_id", "score"]), ("op10_warc", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]),
    ("op11_periodic_runs", ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]), ("op12_substrings", ["doc_id", "n_words", "n_removed", "kept_sha256"]),
    ("op13_ns_bounds", ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]),
])
def test_contract_columns(spark, small, name, columns):
    assert set(columns) <= set(queries.queries()[name](spark, small).columns)
