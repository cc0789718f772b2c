"""Registered queries: a Spark plan over the driver's tables and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    covers: str = ""


_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, covers: str = ""):
    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, fn, sql, covers)
        return fn

    return register


def all_queries() -> dict[str, Query]:
    from cuesheet import plans  # noqa: F401
    from cuesheet.plans import load_all

    load_all()
    return dict(_QUERIES)
