"""Exact quantiles and medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def _ranges(counts: DataFrame, value: str, ranges: int) -> DataFrame:
    """counts with the range of each value; edges are approximate quantiles of the distinct
    values, at most ``ranges`` numbers."""
    edges = sorted(set(counts.approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.25 / ranges)))
    if not edges:
        return counts.withColumn("__r", F.lit(0))
    return counts.withColumn("__r", F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < F.col(value))))


def order_statistics(df: DataFrame, keys: list[str], value: str, places: DataFrame, ranges: int = RANGES) -> DataFrame:
    """keys, place, value: the value at each asked place (from 0) of a group in order of
    value.  places: keys and ``place``.

    Counts a distinct value are cut into ranges; the ranges' totals tell which one holds a
    place, and only that is put in order.  No group is ever in one task as a whole."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.count("*").alias("__n"))
    cut = _ranges(counts, value, ranges)
    totals = cut.groupBy(*keys, "__r").agg(F.sum("__n").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.withColumn("__b", F.coalesce(F.sum("__t").over(before), F.lit(0)))
    asked = places.join(totals, keys).where((F.col("place") >= F.col("__b")) & (F.col("place") < F.col("__b") + F.col("__t")))
    asked = asked.select(*keys, "__r", "__b", "place").distinct()
    inside = cut.join(asked.select(*keys, "__r").distinct(), [*keys, "__r"], "left_semi")
    upto = Window.partitionBy(*keys, "__r").orderBy(value)
    inside = inside.withColumn("__to", F.sum("__n").over(upto))
    found = inside.join(asked, [*keys, "__r"]).where((F.col("place") - F.col("__b") < F.col("__to")) & (F.col("place") - F.col("__b") >= F.col("__to") - F.col("__n")))
    return found.select(*keys, "place", value)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """keys and one column a share: quantiles with linear interpolation between neighbours."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__size"))
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("q")) for k, q in shares.items())))
    at = sizes.select(*keys, "__size", named.alias("s")).select(*keys, "s.name", (F.col("s.q") * (F.col("__size") - 1)).alias("at"), "__size")
    at = at.select(*keys, "name", (F.col("at") - F.floor("at")).alias("part"), F.floor("at").alias("low"), F.least(F.floor("at") + 1, F.col("__size") - 1).alias("high"))
    places = at.select(*keys, F.explode(F.array("low", "high")).alias("place")).distinct()
    held = order_statistics(df, keys, value, places, ranges)
    got = at.join(held.select(*keys, F.col("place").alias("low"), F.col(value).alias("__a")), [*keys, "low"]).join(held.select(*keys, F.col("place").alias("high"), F.col(value).alias("__b")), [*keys, "high"])
    each = F.col("__a") + F.col("part") * (F.col("__b") - F.col("__a"))
    return got.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == k, each)).alias(k) for k in shares))


def upper_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """The middle value, of an even number the upper one."""
    places = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.floor(F.count("*") / 2).alias("place"))
    return order_statistics(df, keys, value, places).select(*keys, F.col(value).alias(out))


def deviation_scale(df: DataFrame, keys: list[str], value: str, factor: float = 1.4826) -> DataFrame:
    """Median absolute deviation from the median, as the scale of a normal distribution."""
    middle = quantiles(df, keys, value, {"__m": 0.5})
    off = df.join(middle, keys).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    return quantiles(off, keys, "__d", {"scale": 0.5}).withColumn("scale", F.col("scale") * factor)
