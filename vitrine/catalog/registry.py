"""Name, query and check SQL of every registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.catalog.roles import Market, with_roles

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, roles: str = ""):
    """Register a function of a ``Market``; ``sql`` may use the roles named in ``roles``."""

    def add(build: Callable[[Market], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, folder: build(Market(spark, folder))
        if sql is not None:
            _ORACLES[name] = with_roles(sql, roles.split())
        return build

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
