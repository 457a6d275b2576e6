"""Values in order along lines: steps, lags, runs and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import circular
from gridloom.operators.fields import known


def along(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def ahead(value: str | Column, keys: list[str], *order: str, by: int = 1) -> Column:
    return F.lead(value, by).over(along(keys, *order))


def behind(value: str | Column, keys: list[str], *order: str, by: int = 1) -> Column:
    return F.lag(value, by).over(along(keys, *order))


def same_at_lag(df: DataFrame, key: str, order: str, value: str, lag: int, width: int) -> DataFrame:
    """How often a value recurs so many samples on, by the way between the two samples."""
    rows = df.select(order, value, ahead(value, [key], order, by=lag).alias("__v"), ahead(order, [key], order, by=lag).alias("__o")).where("__v is not null")
    return rows.groupBy(F.floor((F.col("__o") - F.col(order)) / width).alias("lag_bin")).agg(F.count("*").alias("n"), F.avg(known(F.col(value) == F.col("__v"))).alias("same"))


def presence_at_lags(df: DataFrame, key: str, order: str, value: str, lags: list[int], cut: float) -> DataFrame:
    """For each lag the number of pairs, and the share with at least one end above a cut."""
    rows = df.select(value, *(ahead(value, [key], order, by=n).alias(f"__v{n}") for n in lags))
    pairs = lambda n: F.col(f"__v{n}")
    return rows.agg(*(c for n in lags for c in (F.count(pairs(n)).alias(f"n{n}"), F.avg(F.when(pairs(n).isNotNull(), known(F.greatest(value, pairs(n)) >= cut))).alias(f"s{n}"))))


def shift_profile(points: DataFrame, field: DataFrame, at: str, value: str, shifts: range) -> DataFrame:
    """Mean field value under points moved by whole shifts, and the vertex of the parabola
    through each shift and its neighbours."""
    moved = points.select(at, F.explode(F.array(*(F.lit(s) for s in shifts))).alias("d")).withColumn(at, F.col(at) + F.col("d"))
    means = moved.join(field.select(at, value), at).groupBy("d").agg(F.avg(value).alias("m"))
    w = Window.orderBy("d")  # as many rows as shifts
    p, n, m = F.lag("m").over(w), F.lead("m").over(w), F.col("m")
    bend = p - 2 * m + n
    return means.select("d", m.alias("presence"), F.when(F.abs(bend) > 1e-9, (p - n) / (2 * bend)).alias("vertex"))


def cyclic_switches(df: DataFrame, key: str, order: str, code: str, width: float, period: int) -> DataFrame:
    """Steps between consecutive known codes in units of width, brought to half a period
    either way, and their absolute sum."""
    rows = df.where(F.col(code).isNotNull())
    d = rows.select(key, F.col(code), behind(code, [key], order).alias("__p")).where("__p is not null")
    step = (F.round((F.col(code) - F.col("__p")) / width).cast("int") % period + 3 * (period // 2)) % period - period // 2
    return d.groupBy(key).agg(F.count("*").alias("steps"), F.sum(F.abs(step)).alias("switches"))


def signs_by_band(df: DataFrame, band: Column, turn: Column, period: int) -> DataFrame:
    """Whole turns off, below, at and above zero, by band."""
    k = F.round(turn - period * F.floor(turn / period + 0.5)).cast("int")
    n = lambda c: F.count_if(c)
    return df.select(band.alias("band"), k.alias("k")).groupBy("band").agg(n(F.col("k") < 0).alias("below"), n(F.col("k") == 0).alias("zero"), n(F.col("k") > 0).alias("above"))


def total_turn(df: DataFrame, key: str, order: str, turn: Column) -> DataFrame:
    """Sum of the wrapped differences along each line."""
    rows = df.select(key, order, turn.alias("__t"))
    d = F.col("__t") - behind("__t", [key], order)
    steps = rows.select(key, d.alias("__d")).where("__d is not null").withColumn("__d", F.col("__d") - F.floor(F.col("__d") + 0.5))
    return steps.groupBy(key).agg(F.sum("__d").alias("turns"), F.count("*").alias("steps"))


def rising_share(df: DataFrame, key: str, order: str, code: str) -> DataFrame:
    rows = df.where(F.col(code).isNotNull())
    d = rows.select(circular.code_diff(ahead(code, [key], order), F.col(code)).alias("d")).where("d is not null")
    return d.agg(F.count("*").alias("n"), F.avg(known(F.col("d") > 0)).alias("rising"))


def turn_errors(df: DataFrame, key: str, order: str, code: str, bin_: Column, close: int, period: int = 252) -> DataFrame:
    """Absolute step to the next code, in turns, and the share of small steps, by bin."""
    rows = df.where(F.col(code).isNotNull())
    d = rows.select(bin_.alias("bin"), F.abs(circular.code_diff(ahead(code, [key], order), F.col(code))).alias("d")).where("d is not null")
    return d.groupBy("bin").agg(F.count("*").alias("cells"), F.avg(F.col("d") / float(period)).alias("err"), F.avg(known(F.col("d") < close)).alias("close"))


def runs_per_line(df: DataFrame, key: str, order: list[str], mark: str) -> DataFrame:
    """Number of runs of equal marks of each line, and the sum of its marks."""
    new = F.when(behind(mark, [key], *order) == F.col(mark), 0).otherwise(1)
    return df.select(key, mark, new.alias("__n")).groupBy(key).agg(F.sum("__n").alias("runs"), F.sum(mark).alias("len"))


def seam_contrast(df: DataFrame, keys: list[str], order: list[str], value: str, seam: Column) -> DataFrame:
    """Mean absolute step to the next value, on seams and inside."""
    d = df.select(F.when(seam, "seam").otherwise("interior").alias("part"), F.abs(ahead(value, keys, *order) - F.col(value)).alias("dv")).where("dv is not null")
    return d.groupBy("part").agg(F.count("*").alias("n"), F.avg("dv").alias("mean"))


def second_difference(value: str, keys: list[str], *order: str) -> Column:
    return F.abs(2 * F.col(value) - behind(value, keys, *order) - ahead(value, keys, *order))


def steep_share(df: DataFrame, key: str, order: list[str], value: Column, cut: float) -> DataFrame:
    """Share of places whose steps to the next and the second next value are steep."""
    rows = df.select(key, *order, value.alias("__a"))
    d1, d2 = (ahead("__a", [key], *order, by=n) - F.col("__a") for n in (1, 2))
    steps = rows.select(key, d1.alias("d1"), d2.alias("d2")).where("d2 is not null")
    return steps.groupBy(key).agg(F.count("*").alias("n"), F.avg(known(F.sqrt(F.col("d1") * F.col("d1") + F.col("d2") * F.col("d2")) > cut)).alias("packed"))


def edge_mean(df: DataFrame, keys: list[str], order: str, value: str, reach: int) -> Column:
    """Mean over 2 * reach + 1 samples; beyond either end the last sample is repeated."""
    w, whole = along(keys, order), Window.partitionBy(*keys)
    place, size = F.row_number().over(w), F.count("*").over(whole)
    before, after = F.greatest(F.lit(0), reach + 1 - place), F.greatest(F.lit(0), place + reach - size)
    ends = lambda f, n: f(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * n
    return (F.sum(value).over(w.rowsBetween(-reach, reach)) + ends(F.first, before) + ends(F.last, after)) / (2 * reach + 1)


def gaussian(df: DataFrame, keys: list[str], order: str, value: str, sigma: float) -> Column:
    """Gaussian smoothing over three sigma either way among known samples, its weights made
    to add up to 1; unknown samples stay unknown."""
    from math import ceil, exp

    w, reach = along(keys, order), ceil(3 * sigma)
    total, weight = F.lit(0.0), F.lit(0.0)
    for d in range(-reach, reach + 1):
        v, g = F.lead(value, d).over(w) if d > 0 else F.lag(value, -d).over(w) if d else F.col(value), exp(-0.5 * (d / sigma) ** 2)
        total, weight = total + F.coalesce(v * g, F.lit(0.0)), weight + F.when(v.isNotNull(), g).otherwise(0.0)
    return F.when(F.col(value).isNotNull(), total / weight)


def merge_close(df: DataFrame, key: str, at: str, height: str, apart: float) -> DataFrame:
    """Of two neighbours nearer than ``apart`` the higher stays (the earlier, if level), again
    and again until none are near.  The hits of one line are one short array."""
    hits = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(at).cast("double").alias("at"), F.col(height).cast("double").alias("h")))).alias("hits"))

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        near = (F.size(kept) > 0) & (x["at"] - last["at"] < apart)
        rest = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(~near, F.concat(kept, F.array(x))).when(x["h"] > last["h"], F.concat(rest, F.array(x))).otherwise(kept)

    once = lambda a: F.aggregate(a, F.slice(a, 1, 0), step)
    while True:
        merged = hits.select(key, once(F.col("hits")).alias("hits"), F.size("hits").alias("n"))
        if merged.where(F.size("hits") < F.col("n")).limit(1).count() == 0:
            break
        hits = merged.select(key, "hits")
    return hits.select(key, F.explode("hits").alias("x")).select(key, F.col("x.at").alias(at), F.col("x.h").alias(height))


def next_along(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], width: int) -> DataFrame:
    """df with values (name -> column) of the next row of a line, null at its end, for lines
    of any length: they are cut at multiples of ``width`` of the first order column, and the
    last row of a piece looks at the first one of the next piece (one row a piece)."""
    cut = df.withColumn("__piece", F.floor(F.col(order[0]) / width).cast("long"))
    inside = Window.partitionBy(*keys, "__piece").orderBy(*order)
    ahead = F.lead(F.struct(*(F.col(c).alias(n) for n, c in values.items())), 1).over(inside)
    first = F.min(F.struct(*(F.col(o).alias(f"o{k}") for k, o in enumerate(order)), F.struct(*(F.col(c).alias(n) for n, c in values.items())).alias("v")))
    heads = cut.groupBy(*keys, "__piece").agg(first.alias("__head")).withColumn("__after", F.lead("__head.v").over(Window.partitionBy(*keys).orderBy("__piece"))).drop("__head")
    got = cut.withColumn("__next", ahead).join(heads, [*keys, "__piece"], "left").withColumn("__next", F.coalesce("__next", "__after"))
    return got.select(*df.columns, *(F.col(f"__next.{n}").alias(n) for n in values))
