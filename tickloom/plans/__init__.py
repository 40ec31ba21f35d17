"""The registered queries."""

from tickloom.plans import bars_queries, evaluation_queries, selection_queries, storage_queries  # noqa: F401
from tickloom.plans.registry import QUERIES, SQL


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
