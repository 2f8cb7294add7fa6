"""Session settings the operators are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution joins small sides by broadcast once their true size is known and
# splits partitions that one hot key swells, also where that costs another shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Whether a table is small enough to broadcast is judged by its compressed files.
    "spark.sql.sources.fileCompressionFactor": "3.0",
    # Of many formulas Spark makes one long method. The JVM puts nothing into a method that is near 8,000 bytes and does not
    # compile one beyond; steps that would make one of this length run by themselves, in methods of a few columns each.
    "spark.sql.codegen.hugeMethodLimit": "5000",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
