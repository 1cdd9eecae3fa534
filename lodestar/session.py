"""Session factory: UTC, ANSI, adaptive execution. Sizes are left to the cluster's own settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every query of the package assumes; `conf` adds to them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
