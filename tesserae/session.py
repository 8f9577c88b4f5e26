"""The session that array code runs in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def engine_session(spark: SparkSession | None = None) -> SparkSession:
    """A session on the same context with wrapping integer arithmetic; the caller's settings stay untouched."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if spark.conf.get("spark.sql.ansi.enabled") == "false":
        return spark
    own = spark.newSession()
    own.conf.set("spark.sql.ansi.enabled", "false")
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.enabled"):
        if (value := spark.conf.get(key, None)) is not None:
            own.conf.set(key, value)
    return own
