"""Values of a volume between its cells, and functions of a user over boxes of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
AXES = ("z", "y", "x")
CHUNK = 32
#: Points that one task reads out of one chunk.
POINTS = 1 << 18


def _spread(cells: DataFrame, chunk: int, before: int, after: int) -> DataFrame:
    """cells with cz, cy, cx: once for each chunk that holds them, or has them within
    ``before`` cells below it or ``after`` above it."""
    for a in AXES:
        reach = F.sequence(F.floor((c(a) - after) / chunk), F.floor((c(a) + before) / chunk))
        cells = cells.withColumn(f"c{a}", F.explode(reach))
    return cells


def trilinear(cells: DataFrame, points: DataFrame, level: int = 1, chunk: int = CHUNK) -> DataFrame:
    """points (z, y, x in cells of the finest level, and other columns) with ``value``: the
    trilinear mean of the eight cells around, of cells (z, y, x, v) that are ``level`` of
    the finest wide.  null where one of the eight is not there.

    Cells and points meet by chunk, once: a chunk also has the first layer of the next
    ones, so that a point finds all eight cells in its own.  A chunk that many points fall
    into is read by several tasks."""
    names = points.columns
    held = points.withColumns({f"__{a}": (c(a) + 0.5) / level - 0.5 for a in AXES})
    held = held.withColumns({f"c{a}": F.floor(F.floor(f"__{a}") / chunk) for a in AXES})
    keys = [f"c{a}" for a in AXES]
    known = F.lit(True)
    for a in AXES:
        known = known & c(a).isNotNull() & ~F.isnan(c(a).cast("double"))
    ways = held.where(known).groupBy(*keys).agg(F.ceil(F.count("*") / POINTS).cast("int").alias("cuts"))
    left = _spread(cells.where("v is not null").select(*AXES, "v"), chunk, 0, 1).join(ways, keys).withColumn("sub", F.explode(F.sequence(F.lit(0), c("cuts") - 1))).drop("cuts")
    salt = F.pmod(F.xxhash64(*(c(f"__{a}") for a in AXES)), c("cuts")).cast("int")
    right = held.where(known).join(ways, keys).withColumn("sub", salt).drop("cuts")

    def read(key: tuple, box: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        origin = np.array(key[:3]) * chunk
        grid = np.full((chunk + 1,) * 3, np.nan)
        place = (box[list(AXES)].to_numpy(np.int64) - origin).T
        grid[tuple(place)] = box["v"].to_numpy(float)
        where = at[[f"__{a}" for a in AXES]].to_numpy(float) - origin
        low = np.floor(where).astype(int)
        share = where - low
        value = np.zeros(len(at))
        for corner in product((0, 1), repeat=3):
            weight = np.prod(np.where(corner, share, 1 - share), 1)
            value += weight * grid[tuple((low + corner).T)]
        return at[names].assign(value=pd.Series(value, index=at.index).where(~np.isnan(value), None))

    schema = ", ".join(f"`{n}` {k}" for n, k in points.dtypes) + ", value double"
    met = left.groupBy(*keys, "sub").cogroup(right.groupBy(*keys, "sub")).applyInPandas(read, schema)
    return met.unionByName(points.where(~known).withColumn("value", F.lit(None).cast("double")))


BoxFunction = Callable[[np.ndarray, tuple[int, int, int]], Iterator[tuple]]


def over_boxes(cells: DataFrame, function: BoxFunction, returns: str, halo: int = 0, chunk: int = CHUNK, fill: float = 0.0) -> DataFrame:
    """Rows that a function gives for boxes of a volume.

    The function gets the values of one chunk with ``halo`` cells around it as an array
    (``fill`` where cells has no row) and the place of its first inner cell, and yields rows
    of ``returns`` for what lies inside.  Chunks without a cell, in the halo either, are
    not called."""

    def one(key: tuple, box: pd.DataFrame) -> pd.DataFrame:
        origin = np.array(key) * chunk
        grid = np.full((chunk + 2 * halo,) * 3, fill)
        grid[tuple((box[list(AXES)].to_numpy(np.int64) - origin + halo).T)] = box["v"].to_numpy(float)
        return pd.DataFrame(list(function(grid, tuple(int(x) for x in origin))), columns=[p.split()[0] for p in returns.split(", ")])

    return _spread(cells.select(*AXES, "v"), chunk, halo, halo).groupBy(*(f"c{a}" for a in AXES)).applyInPandas(one, returns)


def register_box_function(spark: SparkSession, name: str, function: BoxFunction, returns: str, halo: int = 0, chunk: int = CHUNK, fill: float = 0.0) -> str:
    """Makes the function callable from SQL, and returns the text of its table argument:

        select * from name(table(boxed) partition by (cz, cy, cx))

    where ``boxed`` is a view of ``with_boxes(cells, halo, chunk)``."""
    from pyspark.sql.functions import udtf

    class Boxes:
        def __init__(self) -> None:
            self.rows: list[tuple] = []

        def eval(self, row) -> None:
            self.rows.append((row["cz"], row["cy"], row["cx"], row["z"], row["y"], row["x"], row["v"]))

        def terminate(self):
            if not self.rows:
                return
            t = np.array(self.rows, float)
            origin = t[0, :3].astype(int) * chunk
            grid = np.full((chunk + 2 * halo,) * 3, fill)
            grid[tuple((t[:, 3:6].astype(int) - origin + halo).T)] = t[:, 6]
            yield from function(grid, tuple(int(x) for x in origin))

    spark.udtf.register(name, udtf(Boxes, returnType=returns))
    return f"{name}(table(boxed) partition by (cz, cy, cx))"


def with_boxes(cells: DataFrame, halo: int = 0, chunk: int = CHUNK) -> DataFrame:
    """cells with cz, cy, cx, once for each chunk that needs them."""
    return _spread(cells.select(*AXES, "v"), chunk, halo, halo)


def eight_corners(z: Column, y: Column, x: Column) -> Column:
    """The cells around a point, and their weights, as an array of structs."""
    rows = []
    for corner in product((0, 1), repeat=3):
        share = F.lit(1.0)
        for v, up in zip((z, y, x), corner, strict=True):
            t = v - F.floor(v)
            share = share * (t if up else 1 - t)
        rows.append(F.struct(*((F.floor(v) + up).alias(a) for a, v, up in zip(AXES, (z, y, x), corner, strict=True)), share.alias("share")))
    return F.array(*rows)
