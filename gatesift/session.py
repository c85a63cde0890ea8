"""A Spark session with the settings which this library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "gatesift", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC, Arrow batches of bounded size.

    Nothing here overrides what a cluster's own configuration decides about memory or cores.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Lower-casing by the JVM: the packs need it only to look for ASCII strings.
        "spark.sql.icu.caseMappings.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
