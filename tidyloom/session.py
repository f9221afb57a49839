"""Session settings that suit these jobs.  All can be changed on a running session."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    # Cleaning many columns makes long generated methods; beyond 8000 bytes the JVM would only interpret them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings to a session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark
