"""Block pooling of voxel tables: one shuffle by block key, combined before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import circular


def block(column: str, factor: int = 2) -> Column:
    return F.floor(F.col(column) / factor).cast("long").alias(column)


def pool(df: DataFrame, mode: str, value: str = "v", keys: tuple[str, ...] = ("z", "y", "x"), factor: int = 2, order: str | None = None) -> DataFrame:
    """Values of a block merged by rule.

    mean: (sum + n/2) / n over all n = factor**len(keys) children, absent ones being fill 0
    max / known_max: largest (null is unknown)        phase: circular mean, resultant rule
    label: unknown if half of the children are, else rounded mean of the known
    void: share of children below the threshold given by ``order``, times 255
    """
    n = factor ** len(keys)
    v = F.col(value)
    g = df.groupBy(*(block(k, factor) for k in keys))
    if mode == "mean":
        out = F.floor((F.coalesce(F.sum(v), F.lit(0)) + n // 2) / n).cast("long")
    elif mode in ("max", "known_max"):
        out = F.max(v)
    elif mode == "phase":
        out = circular.mean_code(v)
    elif mode == "label":
        known = F.count(v)
        out = F.when((F.count("*") - known) * 2 < n, F.floor((F.sum(v) + F.floor(known / 2)) / known)).cast("long")
    elif mode == "void":
        out = F.round(F.avg(F.when(v < int(order or 0), 1.0).otherwise(0.0)) * 255, 6)
    else:
        raise ValueError(f"unknown pooling mode {mode}")
    return g.agg(out.alias(value))
