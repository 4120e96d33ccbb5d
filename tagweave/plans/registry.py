"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where one exists, the equivalent DuckDB SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    from tagweave.plans import (  # noqa: F401
        q_clean, q_joins, q_labels, q_learn, q_metrics, q_pooling, q_sources, q_taxonomy, q_text,
    )
