"""Registry of named queries over the driver's tables.

Each query is ``(spark, base_dir) -> DataFrame``; an optional SQL text states
the same result in plain ANSI SQL over the same tables (views named after the
tables), which is used as an independent oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle SQL string."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return wrap


def load_all() -> None:
    """Import every query module so their registrations run."""
    from murmur.plans import (  # noqa: F401
        annotation_queries,
        audit_queries,
        corpus_queries,
        evaluation_queries,
        explore_queries,
        feature_queries,
        io_queries,
        model_queries,
        sampling_queries,
        text_queries,
        topic_queries,
    )
    from murmur.plans import stream_queries  # noqa: F401  (reuses batch oracle SQL)
