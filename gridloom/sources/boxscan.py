"""Box scans over chunk tables, readers and keyed sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import model


def box(df: DataFrame, low: tuple[int, ...], size: tuple[int, ...], axes: tuple[str, ...] = ("z", "y", "x"), chunk: int | None = None) -> DataFrame:
    """Rows of a half-open box.  Given a chunk side, conditions on the chunk columns come
    along, so that partitions and row groups outside of the box are not read."""
    for a, o, n in zip(axes, low, size, strict=True):
        if chunk:
            df = df.where(F.col(f"c{a}").between(o // chunk, (o + n - 1) // chunk))
        df = df.where((F.col(a) >= o) & (F.col(a) < o + n))
    return df


def write_voxels(df: DataFrame, path: str, chunk: int = model.CHUNK, mode: str = "errorifexists") -> None:
    """Voxels as parquet, sorted by chunk within files dealt by chunk: fill cells are absent
    rows, and row-group statistics prune by chunk."""
    keyed = df.withColumns({f"c{a}": F.floor(F.col(a) / chunk).cast("int") for a in ("z", "y", "x")})
    keyed.repartition("cz", "cy", "cx").sortWithinPartitions("cz", "cy", "cx").write.mode(mode).partitionBy("level").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metric table: tab separated, header, na as null, # comments, repeated headers
    skipped, replicates of a box averaged."""
    raw = spark.read.csv(path, sep="\t", header=True, nullValue="na", comment="#")
    rows = raw.where(F.col("box") != "box")
    return rows.groupBy("tag", "box", "scroll").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in raw.columns if c not in ("tag", "box", "scroll")))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A source catalogue: one JSON document, a row a source."""
    return spark.read.schema(model.SOURCES).json(path, multiLine=True).select(F.explode("sources").alias("s")).select("s.*")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names, sizes and times of a directory tree, without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")


def derived_path(root: str, inputs: dict) -> str:
    """Where the result of these inputs belongs: a digest of their canonical JSON."""
    import hashlib

    return f"{root}/{hashlib.sha256(json.dumps(inputs, sort_keys=True).encode()).hexdigest()}"


def materialised(df: DataFrame, root: str, inputs: dict) -> DataFrame:
    """df as stored under the digest of its inputs, written at first use (the committer
    publishes a whole directory or none of it)."""
    spark, path = df.sparkSession, derived_path(root, inputs)
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    df.write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def missing(wanted: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """What a resumed job still has to do: keys that the output does not hold."""
    return wanted.join(wanted.sparkSession.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
