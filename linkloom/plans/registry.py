"""Queries of the entity-linking operators and the SQL that each is held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
MODULES = ("retrieval", "attributes", "cleaning", "statistics", "training", "scalars", "io", "models", "streams", "records", "mentions")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by the inventory's id, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"linkloom.plans.{m}")
