"""Session settings that the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins and coalesces partitions by measured sizes; skewed partitions are split.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "foliant", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
