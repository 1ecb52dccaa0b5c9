"""A session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; cluster settings (partitions, memory) are left to the cluster unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()
