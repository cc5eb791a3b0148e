"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: javaCharsets lets decode() take windows-1252, in which old playlists and cue sheets are written.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "ferrule", **more: str) -> SparkSession:
    """A session with these settings; more overrides them."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
