"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A payload grows many times when it is walked, so small shuffle blocks are still work.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Tasks hold a fixed amount of text however large the table is: many small shuffle blocks, joined up to this size.
    # Left to itself Spark joins them to one part per core, whose walked payloads and groups then spill.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
    # A task that reads a table holds its rows until they are dealt; beyond its memory they spill, so it reads little however large the table is.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Lists are collected per record or document, which stay small, so hashing many is fine.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
    # Top-k filters prune before the shuffle up to this k, which covers every token budget.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
