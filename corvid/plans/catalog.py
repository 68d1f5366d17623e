"""Registry of named queries: a Spark builder plus, where one can be
written, an independent DuckDB SQL oracle over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    area: str


_REGISTRY: dict[str, Query] = {}


def register(name: str, area: str, oracle: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, oracle, area)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # Import the modules that register queries.
    from corvid.plans import queries_b, queries_c, queries_g, queries_l  # noqa: F401
    from corvid.plans import queries_p, queries_r, queries_s, queries_t, queries_x, queries_z  # noqa: F401
    return dict(_REGISTRY)
