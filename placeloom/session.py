"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionRowLimit": "100000000",
}


def session(app: str = "placeloom", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config(map=CONF)
    return builder.config(map={k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
