"""Queries by name, with the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import dealt_again

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"two queries are named {name}")
    _QUERIES[name] = wraps(query)(lambda spark, sf_dir: query(dealt_again(spark), sf_dir))
    if oracle is not None:
        _ORACLES[name] = oracle


def queries() -> dict[str, Query]:
    from . import catalog, catalog_more, catalog_timeline  # noqa: F401  they register their queries

    return _QUERIES


def oracles() -> dict[str, str]:
    from . import catalog, catalog_more, catalog_timeline  # noqa: F401

    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import catalog

    return catalog.recall(spark, sf_dir)
