"""Vertex grids, tiles and pairs of surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.fields import known
from gridloom.operators.lines import next_along


def bbox(df: DataFrame, key: str, columns: dict[str, tuple[str, float]], valid: Column) -> DataFrame:
    """Extent of the valid rows of a key, padded; columns: name -> (column, pad)."""
    ends = [f for name, (c, pad) in columns.items() for f in ((F.min(c) - pad).alias(f"{name}0"), (F.max(c) + pad).alias(f"{name}1"))]
    return df.where(valid).groupBy(key).agg(*ends)


def crop(df: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows inside half-open ranges."""
    for c, (low, high) in ranges.items():
        df = df.where((F.col(c) >= low) & (F.col(c) < high))
    return df


def rescaled(value: Column, factor: float, origin: float, missing: float = -1.0) -> Column:
    """(value / factor) - origin; negative values mark missing vertices."""
    return F.when(value < 0, F.lit(missing)).otherwise(value / factor - origin)


def affine(matrix: list[list[float]], offset: list[float], *axes: Column) -> list[Column]:
    """Each row of the matrix times the axes, plus its offset."""
    return [sum((m * a for m, a in zip(row, axes, strict=True)), F.lit(0.0)) + o for row, o in zip(matrix, offset, strict=True)]


def touched_shards(df: DataFrame, axes: dict[str, Column], margin: float, side: int) -> DataFrame:
    """Shards that points touch, each point reaching a margin either way."""
    out = df.select(*(c.alias(a) for a, c in axes.items()))
    for a in axes:
        out = out.withColumn(a, F.explode(F.array(F.floor((F.col(a) - margin) / side), F.floor((F.col(a) + margin) / side)))).distinct()
    return out


def outward_share(df: DataFrame, row: list[str], column: list[str], width: int = 65536) -> DataFrame:
    """Share of vertices of a grid (x, y, z) whose normal, by the differences to the next
    vertex of the row and of the column, points outward.  row, column: the key of a line,
    then its order; lines are cut at multiples of ``width`` of the first order column."""
    c = F.col
    n = df
    for name, line in (("u", row), ("v", column)):
        n = next_along(n, line[:1], line[1:], {f"{name}{a}": a for a in "xyz"}, width)
        n = n.withColumns({f"{name}{a}": c(f"{name}{a}") - c(a) for a in "xyz"})
    n = n.where("ux is not null and vx is not null")
    turn = c("x") * (c("uy") * c("vz") - c("uz") * c("vy")) + c("y") * (c("uz") * c("vx") - c("ux") * c("vz"))
    return n.agg(F.count("*").alias("n"), F.avg(known(turn > 0)).alias("outward"))


def mosaic(df: DataFrame, tile: Column, area: float, bright: Column, source: str) -> DataFrame:
    """Pixels, area, share of bright ones and range of sources of each tile."""
    return df.groupBy(tile.alias("tile")).agg(F.count("*").alias("px"), (F.count("*") * area).alias("cm2"), F.avg(known(bright)).alias("bright"), F.min(source).alias("first"), F.max(source).alias("last"))


def bin_means(df: DataFrame, surface: str, bin_: Column, value: str, least: int) -> DataFrame:
    return df.groupBy(F.col(surface).alias("s"), bin_.alias("bin")).agg(F.avg(value).alias("r"), F.count("*").alias("n")).where(F.col("n") >= least).select("s", "bin", "r")


def neighbour_gaps(bins: DataFrame, step: int = 1) -> DataFrame:
    """Mean gap to the next surface over the bins that both have, and how many are crossed."""
    b = bins.select((F.col("s") - step).alias("s"), "bin", F.col("r").alias("__r"))
    gap = F.col("__r") - F.col("r")
    return bins.join(b, ["s", "bin"]).groupBy("s").agg(F.count("*").alias("bins"), F.avg(gap).alias("gap"), F.sum(F.when(gap < 0, 1).otherwise(0)).alias("crossed"))


def best_partner(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """For each surface of a the surface of b with the least mean distance over common bins
    (least first, then the smaller id).  Bins further apart than ``reach`` in r never meet,
    as r is dealt into buckets of that width."""
    x = a.withColumn("__k", F.floor(F.col("r") / reach))
    home = F.floor(F.col("r") / reach)
    y = b.select(F.col("s").alias("other"), "bin", F.col("r").alias("__r"), F.explode(F.array(home - 1, home, home + 1)).alias("__k"))
    pairs = x.join(y, ["bin", "__k"]).where(F.abs(F.col("r") - F.col("__r")) <= reach).groupBy("s", "other").agg(F.avg(F.abs(F.col("r") - F.col("__r"))).alias("d"), F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("s").orderBy(F.round("d", 9), "other"))
    return pairs.withColumn("__i", first).where("__i = 1").drop("__i")


def dominant(points: DataFrame, axes: list[str], source: str, score: str, block: int, reach: int) -> DataFrame:
    """Points of several sources without those that a better source has nearby.

    A source's score in a cubic block is its mean ``score`` there.  A point goes if another
    source has a point within ``reach`` along every axis whose block scores higher, or as
    high with the smaller source.  Adds ``alone``: no other source is near.  Points are
    dealt into cells four times as wide as the reach, the other side into the cells that it
    reaches, 1.5**n of them on average; both joins and groups stay where the cell lies."""
    cells = points.groupBy(source, *axes).agg(F.sum(F.col(score).cast("double")).alias("__sum"), F.count("*").alias("__n"))
    blocks = [F.floor(F.col(a) / block).alias(f"__b{k}") for k, a in enumerate(axes)]
    keys = [f"__b{k}" for k in range(len(axes))]
    each = Window.partitionBy(source, *keys)
    mine = cells.select("*", *blocks).select(source, *axes, (F.sum("__sum").over(each) / F.sum("__n").over(each)).alias("__s"))
    around = mine.select(F.col(source).alias("__o"), F.col("__s").alias("__t"), *(F.col(a).alias(f"__{a}") for a in axes))
    names, near, width = [f"__c{k}" for k in range(len(axes))], mine, 4 * max(reach, 1)
    close = F.col("__o") != F.col(source)
    for name, a in zip(names, axes, strict=True):
        near = near.withColumn(name, F.floor(F.col(a) / width))
        there = F.col(f"__{a}")
        around = around.withColumn(name, F.explode(F.sequence(F.floor((there - reach) / width), F.floor((there + reach) / width))))
        close = close & (F.abs(F.col(a) - there) <= reach)
    around = around.select("__o", "__t", *(f"__{a}" for a in axes), *(F.col(k).alias(f"__n{k}") for k in names))
    beats = (F.col("__t") > F.col("__s")) | ((F.col("__t") == F.col("__s")) & (F.col("__o") < F.col(source)))
    for k in names:
        close = close & (F.col(k) == F.col(f"__n{k}"))
    met = near.join(around, close, "left").groupBy(*names, source, *axes).agg(F.max(beats).alias("__beaten"))
    return met.where(~F.coalesce("__beaten", F.lit(False))).select(source, *axes, F.col("__beaten").isNull().alias("alone"))


def priority_cover(cells: DataFrame, item: str, cell: list[str], priority: str, cover: float) -> DataFrame:
    """Items kept when taken in order of priority (high first, then the smaller item): one is
    dropped if more than ``cover`` of its cells belong to items kept before it.

    A round decides every item whose overlapping items of higher priority are all decided,
    so that the result is that of going through them one by one; there are as many rounds as
    the longest chain of overlapping items in falling priority."""
    from gridloom.operators.graph import checkpoint

    own = checkpoint(cells.groupBy(item, *cell).agg(F.max(priority).alias("__p")))
    size = own.groupBy(item).agg(F.count("*").alias("__size"), F.max("__p").alias("__p"))
    other = own.select(*cell, F.col(item).alias("__i"), F.col("__p").alias("__q"))
    above = (F.col("__q") > F.col("__p")) | ((F.col("__q") == F.col("__p")) & (F.col("__i") < F.col(item)))
    before = checkpoint(own.drop("__p").join(size, item).join(other, cell).where((F.col("__i") != F.col(item)) & above).select(item, "__i").distinct())
    undecided, kept = checkpoint(size.select(item, "__size")), None
    while undecided.limit(1).count():
        waiting = before.join(undecided.select(F.col(item).alias("__i")), "__i").select(item).distinct()
        now = undecided.join(waiting, item, "left_anti")
        if kept is None:
            good = now.select(item)
        else:
            taken = own.join(kept, item).select(*cell).distinct()
            covered = own.join(now.select(item), item).join(taken, cell).groupBy(item).agg(F.count("*").alias("__n"))
            good = now.join(covered, item, "left").where(F.coalesce("__n", F.lit(0)) <= cover * F.col("__size")).select(item)
        kept = checkpoint(good if kept is None else kept.unionByName(good))
        undecided = checkpoint(undecided.join(now.select(item), item, "left_anti"))
    return kept if kept is not None else size.select(item).limit(0)
