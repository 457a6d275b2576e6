"""Stored polylines with packed bounds, and box scans that open only what can meet the box.

``write_lines`` cuts every line into blocks of consecutive points, packs blocks by sorted
tiles (first along x, then y, then z) and writes two tables: ``points``, a folder a tile,
and ``blocks``, the bounds of each block with its tile.  ``scan`` reads the bounds first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
AXES = ("x", "y", "z")
POINTS, BLOCKS = 64, 512
#: Most tiles: their bounds are what a scan holds at the driver.
TILES = 4096


def _slabs(df: DataFrame, axis: str, many: int, held: list[str]) -> DataFrame:
    """df with ``axis_slab``: equal shares by the blocks' middles along the axis, within
    what earlier axes have cut."""
    if many == 1:
        return df.withColumn(f"{axis}_slab", F.lit(0))
    shares = F.array(*(F.lit(k / many) for k in range(1, many)))
    cuts = df.groupBy(*held).agg(F.percentile_approx(f"{axis}_mid", shares, F.lit(1000)).alias("cuts"))
    df = df.join(F.broadcast(cuts), held) if held else df.crossJoin(F.broadcast(cuts))
    return df.withColumn(f"{axis}_slab", F.size(F.filter("cuts", lambda v: v < c(f"{axis}_mid"))).cast("int")).drop("cuts")


def write_lines(lines: DataFrame, path: str, points: int = POINTS, blocks: int = BLOCKS, tiles: int = TILES) -> None:
    """lines: line, seq, x, y, z and other columns; seq counts the points of a line from 0.
    A tile holds about ``blocks`` blocks, or more where ``tiles`` would not hold them all."""
    keyed = lines.withColumn("block", F.floor(c("seq") / points))
    bounds = keyed.groupBy("line", "block").agg(*(f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("points"))
    for a in AXES:
        bounds = bounds.withColumn(f"{a}_mid", (c(f"min_{a}") + c(f"max_{a}")) / 2)
    want = min(tiles, max(1, bounds.count() // blocks))
    side = max(1, round(want ** (1 / 3)))
    held: list[str] = []
    for a, many in zip(AXES, (side, side, max(1, want // (side * side))), strict=True):
        bounds = _slabs(bounds, a, many, held)
        held.append(f"{a}_slab")
    tile = (c("x_slab") * side + c("y_slab")) * F.lit(max(1, want // (side * side))) + c("z_slab")
    bounds = bounds.withColumn("tile", tile.cast("int")).drop(*held, *(f"{a}_mid" for a in AXES))
    bounds.write.parquet(f"{path}/blocks")
    placed = lines.sparkSession.read.parquet(f"{path}/blocks").select("line", "block", "tile")
    dealt = keyed.join(placed, ["line", "block"]).repartition("tile").sortWithinPartitions("tile", "line", "seq")
    dealt.write.partitionBy("tile").parquet(f"{path}/points")


def blocks_in(spark: SparkSession, path: str, low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    """Blocks whose bounds meet the half-open box."""
    rows = spark.read.parquet(f"{path}/blocks")
    for a, lo, hi in zip(AXES, low, high, strict=True):
        rows = rows.where((c(f"max_{a}") >= lo) & (c(f"min_{a}") < hi))
    return rows


def scan(spark: SparkSession, path: str, low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    """Points of the half-open box, as they were written."""
    wanted = blocks_in(spark, path, low, high)
    tiles = [r.tile for r in wanted.select("tile").distinct().collect()]
    rows = spark.read.parquet(f"{path}/points").where(c("tile").isin(tiles))
    rows = rows.join(wanted.select("line", "block"), ["line", "block"], "left_semi")
    for a, lo, hi in zip(AXES, low, high, strict=True):
        rows = rows.where((c(a) >= lo) & (c(a) < hi))
    return rows.drop("tile", "block")


def runs(points: DataFrame) -> DataFrame:
    """line, run, first, last, points: unbroken stretches of a line among points."""
    from pyspark.sql import Window

    w = Window.partitionBy("line").orderBy("seq")
    new = F.when(c("seq") == F.lag("seq").over(w) + 1, 0).otherwise(1)
    marked = points.select("line", "seq", new.alias("new")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy("line", "run").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("points"))
