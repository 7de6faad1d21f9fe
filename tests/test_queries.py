"""Every registered query of the phenotyping library on the smallest tables, held against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from lumicell import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def database():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6) + 0.0


def rows_of(columns, rows):
    order = sorted(columns)
    return sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    frame = plans.queries()[name](spark, SF)
    relation = database.sql(plans.oracle_sql()[name])
    columns = list(relation.columns)
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, relation.fetchall())


@pytest.mark.parametrize("name", ["random_fov", "morphology_solidity", "apply_forest", "save_model"])
def test_queries_without_sql_give_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_the_registry_needs_no_other_subpackage():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['lumicell.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not [n for n in q if n.startswith('op') and '_' in n and n[2].isdigit()], q.keys(); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


@pytest.mark.parametrize("name", "annotate_points display_boundaries find_cell_row label_row_map local_centroid map_cells_to_pixel_rows match_by_centroid prediction_at_points read_region".split())
def test_a_derived_raster_is_not_broadcast_by_a_guess_of_its_size(spark, name):
    """A part row becomes 256 pixels, which Spark's guess from the file's size leaves out; only measured sizes may choose a broadcast."""
    planned = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=false" in planned and "BroadcastExchange" not in planned and "Join" in planned
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") != "-1"


def test_stored_tiles_are_not_broadcast_by_a_guess_of_their_size(spark):
    """Tiles are one binary value each to Spark's guess; the one broadcast is that of the number of cells at each tile, by hint."""
    planned = plans.queries()["match_nearest_label"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert planned.count("BroadcastExchange") == 1 and "SortMergeJoin" in planned


def test_cell_statistics_derives_its_tiles_once(spark, monkeypatch):
    from lumicell import fixtures

    derived, own = [], fixtures.raster_tiles
    monkeypatch.setattr(fixtures, "raster_tiles", lambda *args: derived.append(1) or own(*args))
    assert plans.queries()["cell_statistics"](spark, SF).count() > 0
    assert len(derived) == 1


def test_cell_tables_of_all_images_are_written_in_one_pass(spark, monkeypatch):
    from lumicell.sources import cells

    written, own = [], cells.write_tables
    monkeypatch.setattr(cells, "write_tables", lambda *args: written.append(1) or own(*args))
    assert plans.queries()["read_cell_table"](spark, SF).select("image_id").distinct().count() == 4
    assert len(written) == 1


def test_phenotype_counts_has_the_annotations_too(spark, database):
    events = database.sql("SELECT user_id, event_type FROM events ORDER BY ts, event_id").fetchall()
    last = {user: kind for user, kind in events if kind in ("click", "purchase", "view", "error")}  # the last action on a cell holds, others cancel
    wanted = {("annotation", "positive"): sum(k in ("click", "purchase") for k in last.values()), ("annotation", "negative"): sum(k == "view" for k in last.values())}
    found = {(r["source"], r["label"]): r["n"] for r in plans.queries()["phenotype_counts"](spark, SF).collect()}
    assert {k: n for k, n in found.items() if k[0] == "annotation"} == wanted and all(wanted.values())
    assert {k[0] for k in found} == {"threshold", "model", "annotation"} and sum(n for k, n in found.items() if k[0] == "threshold") == 208
