"""The session that the engine's semantics assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC and ANSI decide results; the rest leaves physical choices to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, app: str = "millrace", **settings: str) -> SparkSession:
    """A session with SETTINGS, overridden by settings (underscores stand for dots)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return b.config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()
