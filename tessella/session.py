"""Session settings shared by tests, bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC everywhere; adaptive execution on, so partition counts and skewed joins are re-planned at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(app: str = "tessella", master: str | None = None, **more: str) -> SparkSession:
    """A session with this library's settings; `more` are further Spark settings with `__` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or "local[*]")
    conf = SETTINGS | {k.replace("__", "."): v for k, v in more.items()}
    return builder.config(map=conf).getOrCreate()
