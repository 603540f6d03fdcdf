"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ``allowDuplicateKeys``: in a JSON object with a repeated key the last one wins.
#: ``unionOutputPartitioning``: Spark 4.1 takes a union for partitioned by a column that one side renames,
#: and joins or grouping above it then lose rows.  ``maxRecordsPerBatch``, ``maxBytesPerBatch``: texts are long, a worker holds a batch of them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
