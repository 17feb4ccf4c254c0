"""All registered queries of the engine but those of its optional training-data part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteloom.plans import estate_queries, harvest_queries, markup_queries, page_queries, profile_queries, stream_queries

_PARTS = (page_queries, estate_queries, profile_queries, markup_queries, harvest_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for part in _PARTS for f in part.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
