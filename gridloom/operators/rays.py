"""Profiles along rays: peaks, crossings and entries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.lines import gaussian
from gridloom.operators.windows import islands


def prominences(v: np.ndarray) -> list[tuple[int, float]]:
    """Local maxima (the first of a plateau) and their prominence.  A stack holds the
    samples that no later one has overtaken, each with the lowest value since it; a sweep
    either way thus knows how deep it was before the last higher sample."""
    n = len(v)
    floors = np.empty((2, n))
    for row, sweep in ((0, range(n)), (1, range(n - 1, -1, -1))):
        stack: list[tuple[float, float]] = []
        for i in sweep:
            low = v[i]
            while stack and stack[-1][0] <= v[i]:
                low = min(low, stack.pop()[1])
            stack.append((v[i], low))
            floors[row, i] = low
    top = 1 + np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] >= v[2:])) if n > 2 else np.zeros(0, int)
    return [(int(i), float(v[i] - floors[:, i].max())) for i in top]


def peaks(df: DataFrame, key: str, order: str, value: str, least: float, apart: int = 1) -> DataFrame:
    """Peaks of a profile with prominence at least ``least``; of two closer than ``apart``
    the higher stays.  A profile is one bounded group."""

    def one(k: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(order, kind="stable")
        v = x[value].to_numpy(float)
        kept: list[tuple[int, float]] = []
        for i, p in sorted((q for q in prominences(v) if q[1] >= least), key=lambda q: (-v[q[0]], q[0])):
            if all(abs(i - j) >= apart for j, _ in kept):
                kept.append((i, p))
        kept.sort()
        return pd.DataFrame({key: [k[0]] * len(kept), "place": [i for i, _ in kept], "height": [float(v[i]) for i, _ in kept], "prominence": [p for _, p in kept]})

    return df.groupBy(key).applyInPandas(one, f"{key} {dict(df.dtypes)[key]}, place long, height double, prominence double")


def ruled_peaks(df: DataFrame, key: str, order: str, value: str, material: str, sigma: float, least: float, window: int, apart: float) -> DataFrame:
    """Peaks of smoothed profiles that begin inside material: key, place (in samples from 0,
    between samples where a parabola says so), height, prominence within ``window`` samples
    either way, and width at half prominence.

    A run of equal samples above both its neighbours is one peak at its middle.  A side
    ends at a higher or unknown sample.  Of two neighbours nearer than ``apart`` the higher
    stays, the earlier if they are level.  Only peaks that stand that near to each other
    are brought together."""
    w = Window.partitionBy(key).orderBy(order)
    known = F.when(~F.isnan(value), F.col(value))
    rows = df.select(key, order, F.col(material).alias("__m"), known.alias("__v"))
    rows = rows.withColumn("__s", gaussian(rows, [key], order, "__v", sigma) if sigma > 0 else F.col("__v"))
    side = lambda lo, hi: F.collect_list(F.struct(F.col("__s").alias("v"))).over(w.rowsBetween(lo, hi))
    rows = rows.withColumns({"__at": F.row_number().over(w) - 1, "__before": F.lag("__s").over(w), "__after": F.lead("__s").over(w), "__left": F.reverse(side(-window, -1)), "__right": side(1, window)})
    runs = islands(rows, [key], [order], F.coalesce(F.col("__before") == F.col("__s"), F.lit(False))).where("__s is not null")
    first, last = (lambda n: F.min_by(n, "__at")), (lambda n: F.max_by(n, "__at"))
    top = runs.groupBy(key, "run").agg(F.min("__at").alias("i"), F.max("__at").alias("j"), first("__s").alias("h"), first("__m").alias("m"), first("__before").alias("a"), last("__after").alias("b"), first("__left").alias("left"), last("__right").alias("right"))
    top = top.where("m and a < h and b < h")

    def until(side: str, stops: str) -> str:
        """How many samples of a side come before the first that stops it."""
        at = f"array_position(transform({side}, x -> coalesce({stops}, true)), true)"
        return f"if({at} = 0, size({side}), cast({at} as int) - 1)"

    low = lambda s: F.expr(f"coalesce(array_min(transform(slice({s}, 1, {until(s, 'x.v > h')}), x -> x.v)), h)")
    top = top.withColumn("tall", F.col("h") - F.greatest(low("left"), low("right"))).where(F.col("tall") >= least)
    wide = F.expr(f"j - i + 1 + {until('left', 'x.v <= h - tall / 2')} + {until('right', 'x.v <= h - tall / 2')}")
    shift = F.expr("case when i = j and a - 2 * h + b < 0 then 0.5D * (a - b) / (a - 2 * h + b) end")
    place = F.when(F.abs(shift) < 1, F.col("i") + shift).otherwise((F.col("i") + F.col("j")) / 2)
    found = top.select(key, place.alias("place"), F.col("h").alias("height"), F.col("tall").alias("prominence"), wide.cast("double").alias("width"))
    if apart <= 0:
        return found
    near = F.col("place") - F.lag("place").over(Window.partitionBy(key).orderBy("place")) < apart
    groups = islands(found, [key], ["place"], near).groupBy(key, "run").agg(F.sort_array(F.collect_list(F.struct("place", "height", "prominence", "width"))).alias("p"))
    kept = f"""aggregate(p, slice(p, 1, 0), (k, x) -> case when size(k) = 0 or x.place - element_at(k, -1).place >= {apart!r}D then array_append(k, x)
        when x.height > element_at(k, -1).height then array_append(slice(k, 1, size(k) - 1), x) else k end)"""
    return groups.select(key, F.explode(F.expr(kept)).alias("x")).select(key, "x.*")


def crossings(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Places where a rising or falling profile meets whole levels, by linear roots."""
    w = Window.partitionBy(key).orderBy(order)
    pair = df.withColumns({"__v": F.lead(value).over(w), "__o": F.lead(order).over(w)}).where(F.col("__v").isNotNull())
    low, high = F.least(value, "__v"), F.greatest(value, "__v")
    levels = F.when(F.floor(high) >= F.ceil(low), F.sequence(F.ceil(low), F.floor(high))).otherwise(F.array().cast("array<bigint>"))
    each = pair.withColumn("level", F.explode(levels)).where((F.col("level") > low) | (F.col(value) == F.col("level")))
    root = F.col(order) + (F.col("__o") - F.col(order)) * F.try_divide(F.col("level") - F.col(value), F.col("__v") - F.col(value))
    return each.select(key, "level", F.coalesce(root, F.col(order).cast("double")).alias("at"))


def entries(df: DataFrame, key: str, order: str, solid: str, shortest: int) -> DataFrame:
    """Void-to-material entries of a ray; runs of material shorter than ``shortest`` are
    ignored."""
    w = Window.partitionBy(key).orderBy(order)
    mark = df.withColumn("__new", F.when(F.lag(solid).over(w) == F.col(solid), 0).otherwise(1))
    run = mark.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = run.groupBy(key, "__run", solid).agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.count_if(F.col(solid) & (F.col("n") >= shortest)).alias("entries"))
