"""Registered queries, composed of operators, with their SQL."""

from lumicell.plans import automated, cell_queries, raster_queries, source_queries, training_queries  # noqa: F401
from lumicell.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
