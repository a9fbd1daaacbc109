"""Registered queries: each operator over the derived tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorehouse.plans.views import Tables
from lorehouse.session import tune

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register a query under its function name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = build(Tables(tune(spark), folder))
            # plain timestamps read the same in every client time zone
            zoned = [f.name for f in out.schema if isinstance(f.dataType, T.TimestampType)]
            return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else out

        name = build.__name__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return build

    return register


def queries() -> dict[str, Query]:
    """All registered queries."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of the registered queries that have one."""
    _load()
    return dict(_SQL)


def _load() -> None:
    from lorehouse.plans import (  # noqa: F401
        graph_queries,
        ingest_queries,
        knowledge_queries,
        report_queries,
        search_queries,
        stream_queries,
        text_queries,
    )
