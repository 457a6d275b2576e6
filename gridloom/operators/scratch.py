"""Tables of one computation in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of our own only where all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="gridloom-"))


class Scratch:
    """Written tables cut the lineage, outlive lost executors, and go when dropped."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top, self.count = spark, f"{shared_folder(spark)}/gridloom-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, *old: DataFrame) -> DataFrame:
        """df as a table; then ``old`` tables, which it took the place of, are dropped."""
        self.count += 1
        path = f"{self.top}/{self.count}"
        df.write.parquet(path)
        for t in old:
            self.drop(t)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: DataFrame) -> None:
        for f in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
            if f"/{self.top.rsplit('/', 1)[1]}/" in f:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str, *order, scratch: Scratch | None = None) -> DataFrame:
    """df with ``name``, the place of each row from 0 in a total order: rows are ranged,
    placed within their range, and ranges know what lies before them; only one count a
    range reaches the driver."""
    scratch = scratch or Scratch(df.sparkSession)
    ranged = scratch.save(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())
    before, at = {}, 0
    for part, n in sizes:
        before[part], at = at, at + n
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    starts = df.sparkSession.createDataFrame(list(before.items()), "__part int, __before long")
    return ranged.withColumn(name, place).join(F.broadcast(starts), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")
