"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def shuffle_settings(input_bytes: int, partition_bytes: int = 128 << 20, least: int = 200) -> dict[str, str]:
    """Shuffle partitions for an input of this size; adaptive execution merges the small ones."""
    n = str(max(least, -(-input_bytes // partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": n,
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": n,
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
    }


def build_session(app_name: str = "tallyroll", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
