"""Kernels on voxel grids: dilation, distance, tiles, surfaces."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def ball(radius: int, dims: int = 3) -> list[tuple[int, ...]]:
    return [o for o in product(range(-radius, radius + 1), repeat=dims) if sum(i * i for i in o) <= radius * radius]


def dilate(df: DataFrame, value: str, radius: int, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Largest value within a ball, for every cell that any set cell reaches."""
    offsets = F.array(*(F.struct(*(F.lit(v).alias(a) for a, v in zip(axes, o, strict=True))) for o in ball(radius, len(axes))))
    out = df.select(value, *axes, F.explode(offsets).alias("o"))
    return out.groupBy(*((F.col(a) + F.col(f"o.{a}")).alias(a) for a in axes)).agg(F.max(value).alias(value))


def distance(df: DataFrame, feature: str, side: int, halo: int, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Squared distance of every cell to the nearest feature cell within ``halo``, else null.

    Cells are dealt into cubes; features are copied to the cubes that they can reach, and
    each cube measures its own cells: separable minima, one axis after another."""
    cube = [F.floor(F.col(a) / side).cast("long").alias(f"c_{a}") for a in axes]
    own = df.select(*axes, *cube, F.lit(True).alias("own"), F.col(feature).alias("f"))
    steps = F.array(*(F.struct(*(F.lit(v).alias(a) for a, v in zip(axes, o, strict=True))) for o in product((-1, 0, 1), repeat=len(axes)) if any(o)))
    far = df.where(feature).select(*axes, F.explode(steps).alias("o")).select(*axes, *((F.floor(F.col(a) / side) + F.col(f"o.{a}")).cast("long").alias(f"c_{a}") for a in axes), F.lit(False).alias("own"), F.lit(True).alias("f"))
    near = None
    for a in axes:
        c = (F.col(a) >= F.col(f"c_{a}") * side - halo) & (F.col(a) < (F.col(f"c_{a}") + 1) * side + halo)
        near = c if near is None else near & c
    keys = [f"c_{a}" for a in axes]

    def one(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        low = [int(k) * side - halo for k in key]
        shape = (side + 2 * halo,) * len(axes)
        d = np.full(shape, np.inf)
        f = x[x["f"]]
        d[tuple((f[a] - lo).to_numpy() for a, lo in zip(axes, low, strict=True))] = 0
        n = np.arange(shape[0])
        step = (n[:, None] - n[None, :]) ** 2.0
        for k in range(len(axes)):
            moved = np.moveaxis(d, k, -1)
            d = np.moveaxis((moved[..., None, :] + step).min(-1), -1, k)
        mine = x[x["own"]]
        got = d[tuple((mine[a] - lo).to_numpy() for a, lo in zip(axes, low, strict=True))]
        return mine[list(axes)].assign(d2=np.where(got <= halo * halo, got, np.nan))

    kinds = dict(df.dtypes)
    out = own.unionByName(far.where(near)).groupBy(*keys).applyInPandas(one, ", ".join(f"{a} {kinds[a]}" for a in axes) + ", d2 double")
    return out.withColumn("d2", F.nanvl("d2", F.lit(None).cast("double")))


def nearest_features(df: DataFrame, features: dict[str, Column], side: int, reach: int, axes: tuple[str, ...] = AXES, carry: tuple[str, ...] = ()) -> DataFrame:
    """For every cell and each named feature the nearest cell that has it, within ``reach``:
    name_d2, name_<axis> and name_<column> of the columns to carry, null where there is none;
    ties go to the smallest coordinates.

    Cells are dealt into cubes and features also to cubes within reach.  In a cube, squared
    distance and place share one integer, which is separable: one axis after another."""
    names = list(features)
    marked = df.select(*axes, *carry, *(F.coalesce(f, F.lit(False)).alias(f"__f_{n}") for n, f in features.items()))
    home = {a: F.floor(F.col(a) / side).cast("long") for a in axes}
    steps = -(-reach // side)
    far = marked.where(F.greatest(*(F.col(f"__f_{n}").cast("int") for n in names), F.lit(0)) > 0)
    for a in axes:
        far = far.withColumn(f"__c_{a}", F.explode(F.sequence(home[a] - steps, home[a] + steps)))
        far = far.where((F.col(a) >= F.col(f"__c_{a}") * side - reach) & (F.col(a) < (F.col(f"__c_{a}") + 1) * side + reach))
    own = marked.select("*", *(home[a].alias(f"__c_{a}") for a in axes), F.lit(True).alias("__own"))
    other = F.lit(False)
    for a in axes:
        other = other | (F.col(f"__c_{a}") != home[a])
    keys = [f"__c_{a}" for a in axes]
    wide = side + 2 * reach
    unit = wide ** len(axes)

    def one(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        low = [int(k) * side - reach for k in key]
        cell = tuple((x[a] - lo).to_numpy() for a, lo in zip(axes, low, strict=True))
        flat = np.ravel_multi_index(cell, (wide,) * len(axes))
        mine = np.flatnonzero(x["__own"].to_numpy())
        out = x.iloc[mine][list(axes)].reset_index(drop=True)
        for n in names:
            has = np.flatnonzero(x[f"__f_{n}"].to_numpy())
            best = np.full((wide,) * len(axes), np.iinfo(np.int64).max // 4, np.int64)
            best.ravel()[flat[has]] = flat[has]
            for k in range(len(axes)):
                moved, at = np.moveaxis(best, k, -1), np.arange(wide, dtype=np.int64)
                best = np.moveaxis(np.stack([(moved + (at - q) ** 2 * unit).min(-1) for q in range(wide)], -1), -1, k)
            got = best.ravel()[flat[mine]]
            d2, source = got // unit, got % unit
            known = d2 <= reach * reach
            out[f"{n}_d2"] = pd.array(np.where(known, d2, 0), "Int64")
            row = np.zeros(unit, np.int64)
            row[flat[has]] = has
            for c in (*axes, *carry):
                out[f"{n}_{c}"] = x[c].iloc[row[np.where(known, source, 0)]].reset_index(drop=True).astype("Int64")
            out.loc[~known, [f"{n}_d2", *(f"{n}_{c}" for c in (*axes, *carry))]] = pd.NA
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join([f"{a} {kinds[a]}" for a in axes] + [f"{n}_{c} long" for n in names for c in ("d2", *axes, *carry)])
    return own.unionByName(far.where(other).withColumn("__own", F.lit(False))).groupBy(*keys).applyInPandas(one, schema)


def exact_distance(df: DataFrame, feature: str, axes: tuple[str, ...] = AXES, start: float = 4.0) -> DataFrame:
    """Squared distance of every listed cell to the nearest feature cell, however far, and
    that cell (ties to the smallest coordinates); null where there is no feature at all."""
    from gridloom.operators.joins import nearest

    cells = df.select(*axes).distinct().withColumn("__id", F.struct(*axes))
    marked = df.where(feature).select(*axes).distinct().withColumn("near", F.struct(*axes))
    got = nearest(cells, marked, list(axes), "__id", "near", start=start)
    return cells.join(got, "__id", "left").select(*axes, "d2", *(F.col(f"near.{a}").alias(f"near_{a}") for a in axes))


def tiles(low: tuple[int, ...], size: tuple[int, ...], side: int, overlap: int, spark) -> DataFrame:
    """Half-open tiles of a box, each reaching ``overlap`` into its neighbours."""
    out = spark.range(1).select(F.lit(0).alias("_"))
    for a, o, n in zip(AXES, low, size, strict=True):
        out = out.withColumn(f"{a}0", F.explode(F.sequence(F.lit(o), F.lit(o + n - 1), F.lit(side))))
        out = out.withColumn(f"{a}1", F.least(F.col(f"{a}0") + side + overlap, F.lit(o + n))).withColumn(f"{a}0", F.greatest(F.col(f"{a}0") - overlap, F.lit(o)))
    return out.drop("_")


def jacobian(df: DataFrame, key: str, span: int = 1, side: int = 256) -> DataFrame:
    """Stretch of a vertex grid (key, row, col, x, y, z) by central differences: singular
    values s1 >= s2 of the map from grid to space, distortion and area; null where a vertex
    ``span`` away is not listed.

    Grids are cut into blocks that hold the ``span`` vertices around them too."""
    home = {a: F.floor(F.col(a) / side).cast("long") for a in ("row", "col")}
    place = lambda da, db: F.struct((home["row"] + da).alias("i"), (home["col"] + db).alias("j"))
    near = lambda a, d: F.pmod(F.col(a), F.lit(side)) < span if d < 0 else F.pmod(F.col(a), F.lit(side)) >= side - span
    to = [place(0, 0)] + [F.when(near("row", d), place(d, 0)) for d in (-1, 1)] + [F.when(near("col", d), place(0, d)) for d in (-1, 1)]
    dealt = df.withColumn("__to", F.explode(F.filter(F.array(*to), lambda x: x.isNotNull()))).withColumn("__own", (F.col("__to.i") == home["row"]) & (F.col("__to.j") == home["col"]))
    dealt = dealt.withColumns({"__i": F.col("__to.i"), "__j": F.col("__to.j")}).drop("__to").repartition(key, "__i", "__j")
    r, c = Window.partitionBy(key, "__i", "__j", "col").orderBy("row"), Window.partitionBy(key, "__i", "__j", "row").orderBy("col")
    at = lambda v, w, by: F.max(v).over(w.rangeBetween(by, by))  # noqa: E731  (the one vertex there, if listed)
    d = lambda v, w: (at(v, w, span) - at(v, w, -span)) / (2.0 * span)
    g = dealt.withColumns({f"u{v}": d(v, c) for v in "xyz"} | {f"v{v}": d(v, r) for v in "xyz"}).where("__own").drop("__own", "__i", "__j")
    dot = lambda a, b: sum((F.col(a + v) * F.col(b + v) for v in "xyz"), F.lit(0.0))
    e, f, h = dot("u", "u"), dot("u", "v"), dot("v", "v")
    root = F.sqrt(F.pow(e - h, 2) + 4 * f * f)
    s1, s2 = F.sqrt((e + h + root) / 2), F.sqrt(F.greatest(F.lit(0.0), (e + h - root) / 2))
    return g.withColumns({"s1": s1, "s2": s2}).withColumns({"distortion": F.greatest(F.col("s1"), F.try_divide(F.lit(1.0), F.col("s2"))) - 1, "area": F.col("s1") * F.col("s2")})


def erode(df: DataFrame, radius: int, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Cells whose whole ball is set (cells that are not listed are not set)."""
    n = len(ball(radius, len(axes)))
    offsets = F.array(*(F.struct(*(F.lit(v).alias(a) for a, v in zip(axes, o, strict=True))) for o in ball(radius, len(axes))))
    hit = df.select(*axes, F.explode(offsets).alias("o")).groupBy(*((F.col(a) + F.col(f"o.{a}")).alias(a) for a in axes)).agg(F.count("*").alias("n"))
    return hit.where(F.col("n") == n).select(*axes)


def close(df: DataFrame, radius: int, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Dilation, then erosion, by a ball."""
    return erode(dilate(df.select(*axes).distinct().withColumn("s", F.lit(1)), "s", radius, axes).select(*axes), radius, axes)


def touching(df: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Pairs (cell, other) of ids of set cells that share a face; id is a column of df."""
    pairs = None
    for a in axes:
        right = df.select(F.col("id").alias("other"), *((F.col(c) - (1 if c == a else 0)).alias(c) for c in axes))
        p = df.select(F.col("id").alias("cell"), *axes).join(right, list(axes)).select("cell", "other")
        pairs = p if pairs is None else pairs.unionByName(p)
    return pairs


def drop_small(df: DataFrame, least: int, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Set cells of face-connected components of at least so many cells."""
    from gridloom.operators.graph import components

    cells = df.select(*axes).distinct().withColumn("id", F.concat_ws(",", *axes))
    part = cells.join(components(touching(cells, axes), "cell", "other").withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    big = part.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return part.join(big, "component", "left_semi").select(*axes)


def largest_rectangle(df: DataFrame, key: str, good: str) -> DataFrame:
    """Largest axis-parallel rectangle of good cells of each grid (key, row, col), cells that
    are not listed being bad; ties go to the topmost, then leftmost, then tallest.  All zeros
    where no cell is good.

    Heights of good cells above each cell come from runs along the columns; a row of heights
    is the largest group, and rows only hand on their best rectangle."""
    up = Window.partitionBy(key, "col").orderBy("row")
    runs = df.where(good).select(key, "row", "col").distinct().withColumn("__run", F.col("row") - F.row_number().over(up))
    tall = runs.withColumn("h", F.row_number().over(Window.partitionBy(key, "col", "__run").orderBy("row")))

    def one(k: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("col")
        best, open_ = (0, 0, 0, 0, 0), []
        last = None
        for c, h in [*zip(x["col"].tolist(), x["h"].tolist(), strict=True), (None, 0)]:
            for at, height in ((last + 1, 0), (c, h)) if last is not None and c != last + 1 else ((c, h),):
                start = at
                while open_ and open_[-1][1] >= height:
                    start, high = open_.pop()
                    best = max(best, (high * (at - start), high - int(k[1]) - 1, -start, high, at - start))
                if height:
                    open_.append((start, height))
            last = c
        area, top, left, high, wide = best
        return pd.DataFrame({key: [k[0]], "area": [area], "top": [top], "left": [left], "rows": [high], "cols": [wide]})

    kind = dict(df.dtypes)[key]
    best = tall.groupBy(key, "row").applyInPandas(one, f"{key} {kind}, area long, top long, left long, rows long, cols long").groupBy(key).agg(F.max(F.struct("area", "top", "left", "rows", "cols")).alias("m"))
    got = lambda f: F.coalesce(f, F.lit(0).cast("long"))
    return df.select(key).distinct().join(best, key, "left").select(key, got(F.col("m.area")).alias("area"), got(-F.col("m.top")).alias("row"), got(-F.col("m.left")).alias("col"), got(F.col("m.rows")).alias("rows"), got(F.col("m.cols")).alias("cols"))
