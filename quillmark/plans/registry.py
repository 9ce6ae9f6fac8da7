"""All queries of the engine and their SQL oracles, gathered from the plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name`` with its SQL oracle, if it has one."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if oracle is not None:
            _ORACLES[name] = oracle
        return function

    return add


def oracle_sql_of(name: str) -> str:
    """The SQL of a query that is registered already, for another way to the same rows."""
    return _ORACLES[name]


def _load() -> None:
    """Import the plan modules; each registers its queries."""
    from . import corpus, graph, identifiers, merging, processing, retrieval, sqlfunctions, validation  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
