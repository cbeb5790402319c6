"""All queries by name, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with the SQL of the same result where there is one."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


#: Modules of this package that register queries.
MODULES = ("q_binning", "q_cells", "q_filters", "q_joins", "q_knn", "q_manifold", "q_reduce", "q_report", "q_settings", "q_stats", "q_streams", "q_views")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lumenvec.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["knn4"](spark, sf_dir)
