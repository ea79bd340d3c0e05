"""The Spark session the library expects; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "wayframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with runtime re-planning; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
