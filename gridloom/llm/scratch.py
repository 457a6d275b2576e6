"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names.  A folder of our own serves only where everything
    runs on one machine; elsewhere a missing setting is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="gridloom-"))


class Scratch:
    """Tables of one computation.  A table is written, read again (which cuts the lineage and
    outlives lost executors) and may be dropped once nothing will read it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top, self.count = spark, f"{shared_folder(spark)}/gridloom-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.top}/{name}-{self.count}"
        with tidy(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    return Scratch(df.sparkSession).save(df, name)


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it has run."""
    before = spark.conf.get(_CLEANUP, None)
    if before is None:  # an older Spark without the setting keeps them a little longer
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)
