"""Session defaults that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps hour() and casts of zone-less timestamps alike everywhere; the adaptive
#: settings let Spark merge small and split skewed shuffle partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "gridloom", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
