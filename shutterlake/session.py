"""The session the library is used with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str = "local[*]", app: str = "shutterlake", **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution on. ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
