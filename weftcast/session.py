"""A session as the library expects it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "weftcast", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; anything in ``conf`` wins. ANSI mode stays on, so the library divides with try_divide."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    return builder.config(map=settings | conf).getOrCreate()
