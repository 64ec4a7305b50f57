"""Registry of runnable queries: readable name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = fn
        return fn

    return register


def load() -> dict[str, Query]:
    from . import bindings  # noqa: F401  (fills the registry)

    return dict(REGISTRY)
