"""All registered queries by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = run
    if sql is not None:
        _SQL[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


from marlstone.plans import blend_queries, bundle_queries, decision_queries, domain_queries, economics_queries, estimate_queries, family_queries, field_queries, group_queries, market_queries, matching_queries, report_queries, rule_queries, stream_queries, value_queries, vehicle_queries  # noqa: E402, F401  they register their queries
