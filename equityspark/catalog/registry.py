"""Registered queries: a Spark callable per id and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from equityspark.catalog import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, fn: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} registered twice")
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        register(name, fn, sql)
        return fn

    return wrap


def oracle_texts() -> dict[str, str]:
    """Complete SQL per query; view definitions are resolved once everything is loaded."""
    return {name: oracle.sql(text) for name, text in ORACLE.items()}


def _load() -> None:
    from equityspark.catalog import (  # noqa: F401
        q_annotate, q_backtest, q_events, q_features, q_indicators, q_long, q_memory, q_models, q_scores, q_screens,
        q_sources, q_stores, q_text,
    )
