"""Session settings for stand-alone use; every operator also runs on a session made elsewhere."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "logtide", master: str | None = None, **conf: str) -> SparkSession:
    """Session in UTC with AQE. Cluster sizes are left to ``spark-submit`` and to AQE."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()
