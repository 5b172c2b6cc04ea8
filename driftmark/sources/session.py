"""Session settings the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # The pair classifier generates large methods; beyond 8,000 bytes the JVM would interpret
    # them, so such stages fall back to one (split) projection at a time.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Re-plan joins, split skewed join sides and merge small shuffle partitions at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more shuffle further down.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A row handed to Python may hold a whole block of a series, so few rows make a batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # Derived timestamps and dates must not depend on where the driver runs.
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Sets what the session leaves open; settings of the caller stay."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark
