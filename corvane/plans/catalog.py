"""All registered queries outside the llm folder, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that says the same."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


from corvane.plans import bundle_queries, dedup_queries, embed_queries, extract_queries, graph_queries, import_queries, ops_queries, project_queries, search_queries, stream_queries, text_queries  # noqa: E402,F401
