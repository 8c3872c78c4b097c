"""All queries over the data model, and their SQL."""

from __future__ import annotations

from keyfold.plans import keyspace_queries, log_queries, ordered_queries, storage_queries, stream_queries, typed_queries
from keyfold.plans.registry import QUERIES, SQL

MODULES = (log_queries, keyspace_queries, typed_queries, ordered_queries, storage_queries, stream_queries)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
