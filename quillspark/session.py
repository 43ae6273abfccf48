"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
}


def sql_session(spark: SparkSession) -> SparkSession:
    """A sibling session for user SQL: exact names, ``"quoted"`` identifiers; other sessions keep their settings."""
    own = spark.newSession()
    for k, v in SETTINGS.items():
        own.conf.set(k, v)
    return own
