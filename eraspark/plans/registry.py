"""Query registry: each named query is a Spark builder ``(spark, sf_dir) ->
DataFrame`` plus, where the result is SQL-expressible, the equivalent DuckDB
statement over the same tables (the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from . import q_corpus, q_features, q_ingest, q_io, q_links, q_models, q_sampling, q_scoring, q_variants  # noqa: F401
    return QUERIES
