"""Registry of named queries over the fixture tables.

Each entry pairs a Spark builder ``fn(spark, sf_dir) -> DataFrame`` with an
optional DuckDB twin (ANSI SQL over the pre-registered fixture views).  Entries
without SQL are checked by golden pytest fixtures instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    group: str


_REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, group: str = ""):
    """Decorator registering a query builder under ``name``."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Entry(name, fn, sql.strip() if sql else None, group or fn.__module__)
        return fn

    return deco


def entries() -> dict[str, Entry]:
    from tessera import plans  # noqa: F401  (imports every plan module)

    return dict(_REGISTRY)
