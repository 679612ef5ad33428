"""Names of the engine's own queries, their functions and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from scholion.sources.bind import with_tables

MODULES = ("spine", "relational", "aggregation", "windows", "texts", "quality", "merging", "policy", "editing", "composite", "packages", "states", "aliases", "canons")

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its DuckDB equivalent where SQL has one."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _ORACLE[name] = with_tables(sql)
        return function

    return add


def sql_of(name: str) -> str:
    """The oracle of a query that is registered already, to be put together with others."""
    return _ORACLE[name]


def _load() -> None:
    for name in MODULES:
        import_module(f"scholion.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["context_bundle_doc"](spark, sf_dir)
