"""Registered queries, each with the SQL that must give the same rows (or none where SQL cannot say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.plans.views import Tables, with_views

_QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = (build, sql)
        return build

    return register


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero: the engines differ in the last bit of a double."""
    return F.round(c, digits) + F.lit(0.0)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bind(build) for name, (build, _) in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return {name: with_views(sql, "MATERIALIZED") for name, (_, sql) in _QUERIES.items() if sql}


def _load() -> None:
    from scoreweave.plans import (  # noqa: F401
        aggregate_queries, evidence_queries, field_queries, join_queries, model_queries, source_queries, text_queries,
    )
