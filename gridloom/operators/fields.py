"""Cells and fields: recoding, gating, blending and pooling of values on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import circular
from gridloom.model import PERIOD


def known(condition: Column) -> Column:
    """1.0 or 0.0, so that its mean is a share."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def logit(p: Column, floor: float = 0.002) -> Column:
    """Log odds of a probability kept off both ends."""
    q = F.least(F.lit(1 - floor), F.greatest(F.lit(floor), p))
    return F.log(q / (1 - q))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def smoothstep(x: Column, low: float, high: float) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))
    return t * t * (3 - 2 * t)


def ramp(x: Column, low: float, width: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / width))


def recode(df: DataFrame, value: str, table: DataFrame, key: str, code: str, missing: int) -> DataFrame:
    """``value`` looked up in a table (key, code); values that it lacks become ``missing``.
    The table is a byte's worth of rows, one for each key."""
    codes = table.select(F.col(key).alias("__k"), F.col(code).alias("__c")).dropDuplicates(["__k"])
    out = df.join(codes, F.col(value) == F.col("__k"), "left").withColumn(value, F.coalesce("__c", F.lit(missing)))
    return out.drop("__k", "__c")


def window_gate(value: Column, inside: Column, outside: int = 255) -> Column:
    """The whole part of a value where the gate holds, the ignored label elsewhere."""
    return F.when(inside, F.floor(value).cast("int")).otherwise(F.lit(outside))


def gate_byte(value: Column, *gates: Column) -> Column:
    """A byte dimmed by the largest of some byte gates, rounded; absent gates are 0."""
    return F.floor((value * F.greatest(*(F.coalesce(g, F.lit(0)) for g in gates)) + 127) / 255)


def first_known(left: DataFrame, key: str, *others: tuple[DataFrame, str], out: str = "code", last: Column | None = None) -> DataFrame:
    """For each key the first of the named columns of other relations that is known."""
    names = []
    for k, (df, column) in enumerate(others):
        names.append(f"__v{k}")
        left = left.join(df.select(key, F.col(column).alias(names[-1])), key, "left")
    return left.withColumn(out, F.coalesce(*names, *([] if last is None else [last]))).drop(*names)


def agreement(df: DataFrame, key: str, code: str, least: float = 0.5) -> DataFrame:
    """Resultant length of the known codes of a key, null where too few are known."""
    c, s = (F.avg(x) for x in circular.phasor(F.col(code)))
    share = F.avg(known(F.col(code).isNotNull()))
    got = df.groupBy(key).agg(F.sqrt(c * c + s * s).alias("conf"), share.alias("known"))
    return got.withColumn("conf", F.when(F.col("known") >= least, F.col("conf")))


def share_within(df: DataFrame, keys: list[str | Column], condition: Column, out: str, scale: float = 1.0) -> DataFrame:
    """Share of a group's rows for which the condition holds."""
    return df.groupBy(*keys).agg((F.avg(known(condition)) * scale).alias(out))


def parity_halves(df: DataFrame, keys: list[Column], axes: tuple[str, ...], value: str) -> DataFrame:
    """Means over cells of even and of odd coordinate sum, and over all."""
    odd = sum((F.col(a) for a in axes), F.lit(0)) % 2 == 1
    return df.groupBy(*keys).agg(F.avg(F.when(~odd, F.col(value))).alias("even"), F.avg(F.when(odd, F.col(value))).alias("odd"), F.avg(value).alias("whole"))


def pool_codes(df: DataFrame, cell: str, order: str, code: str, tolerance: int, unknown: int = 255) -> DataFrame:
    """The first code of each cell, unknown if any other is further off than the tolerance."""
    rows = df.where(F.col(code).isNotNull())
    first = rows.groupBy(cell).agg(F.min_by(code, order).alias("first"))
    off = F.max(F.abs(circular.code_diff(F.col(code), F.col("first"))))
    return rows.join(first, cell).groupBy(cell).agg(F.when(off > tolerance, F.lit(unknown)).otherwise(F.max("first")).alias(code))


def blend_logits(df: DataFrame, cell: str, p: Column, weight: Column) -> DataFrame:
    """Probabilities averaged as log odds under tile weights."""
    z = df.select(cell, logit(p).alias("z"), weight.alias("w")).groupBy(cell).agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))
    return z.select(cell, logistic(F.col("z")).alias("p"))


def blend_values(df: DataFrame, cell: str, value: Column, weight: Column) -> DataFrame:
    """Weighted mean under tile weights."""
    return df.select(cell, value.alias("v"), weight.alias("w")).groupBy(cell).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def tile_weight(place: Column, size: int) -> Column:
    """sin squared of the place in a tile, never quite 0."""
    return F.greatest(F.pow(F.sin((place + 0.5) * 3.141592653589793 / size), 2), F.lit(1e-6))


def blend_fields(df: DataFrame, cell: str, code: str, weight: str) -> DataFrame:
    """Confidence of the weighted complex mean, largest weight, and weight-weighted mean
    weight of the positive rows of a cell."""
    rows, (c, s), w = df.where(F.col(weight) > 0), circular.phasor(F.col(code)), F.col(weight)
    sums = rows.groupBy(cell).agg(F.sum(w * c).alias("c"), F.sum(w * s).alias("s"), F.sum(F.when(F.col(code).isNotNull(), w)).alias("w"), F.max(w).alias("top"), (F.sum(w * w) / F.sum(w)).alias("mean"))
    return sums.where("w > 0").select(cell, (F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("w")).alias("conf"), "top", "mean")


def rank_ensemble(df: DataFrame, key: str, group: str, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the percentile ranks that some scores give within a group."""
    total = sum(weights.values())
    ranks = {f"__r{k}": F.percent_rank().over(Window.partitionBy(group).orderBy(c)) for k, c in enumerate(weights)}
    mean = sum((w * F.col(r) for r, w in zip(ranks, weights.values(), strict=True)), F.lit(0.0)) / total
    return df.withColumns(ranks).select(key, mean.alias("rank_mean"))


def soft_label(teacher: Column, student: Column, share: float) -> Column:
    """Two probabilities mixed as log odds."""
    return logistic(share * logit(teacher) + (1 - share) * logit(student))


def difference_histogram(a: DataFrame, b: DataFrame, keys: list[str], value: str, width: int, cut: int) -> DataFrame:
    """Histogram of absolute differences of two sparse volumes (absent cells are 0), and how
    many cells lie on either side of a cut."""
    both = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys, "full_outer")
    u, v = F.coalesce("__a", F.lit(0)), F.coalesce("__b", F.lit(0))
    return both.groupBy(F.floor(F.abs(u - v) / width).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.when((u >= cut) != (v >= cut), 1).otherwise(0)).alias("flips"))


def quantised(value: Column, step: float) -> Column:
    """The nearest multiple of step, halves upwards."""
    return F.floor(value / step + 0.5) * step


def quantisation_error(df: DataFrame, value: str, step: float) -> DataFrame:
    e = F.abs(F.col(value) - quantised(F.col(value), step))
    return df.agg(F.count("*").alias("n"), F.avg(e).alias("mean_err"), F.max(e).alias("max_err"))


def summary(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v.cast("double")).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))
