"""All registered queries, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatesift.plans import catalog_queries, content_queries, gateway_queries, regulated_queries, session_queries, traffic_queries

MODULES = (content_queries, regulated_queries, gateway_queries, traffic_queries, session_queries, catalog_queries)
flagship = regulated_queries.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
