"""Where queries and their SQL are kept by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from lumicell.fixtures import with_views
from lumicell.functions.rank import broadcasts_by_measured_size

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB form over the tables and the named fixture views."""

    def keep(function: Callable) -> Callable:
        @wraps(function)
        def run(spark, sf):
            broadcasts_by_measured_size(spark)
            return function(spark, sf)

        QUERIES[name] = run
        if sql:
            SQL[name] = with_views(views, sql) if views else sql
        return function

    return keep
