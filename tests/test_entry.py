"""The entry points that the checks call."""

import __spark_entry__


def test_entry_gives_counts_of_calls(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {r["image_id"] for r in rows} == {0, 1, 2, 3} and sum(r["cells"] for r in rows) == 208


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
