"""Merging label, vote, code and field sets cell by cell.

All merges are groupings of a union by the cell key: partial aggregation runs before the
one shuffle, except where a rule depends on order or on all values together; those collect
one short array a cell (as many values as there are sets, or as there are codes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import circular
from gridloom.model import PERIOD

VOTE_MOST = 15
CODE_STEPS = 4


def fuse_phase(df: DataFrame, keys: list[str], code: str, tol: int, period: int = PERIOD) -> DataFrame:
    """Circular mean of the known codes of a cell if all lie within tol of each other.

    outcome: 'none' known, 'single', 'agree' or 'conflict' (code null).  Rows are counted by
    code first, so that a cell holds one entry a code, however many rows it has."""
    each = df.groupBy(*keys, code).agg(F.count("*").alias("__n"))
    some = F.when(F.col(code).isNotNull(), F.struct(F.col(code).alias("c"), F.col("__n").alias("n")))
    known = each.groupBy(*keys).agg(F.sort_array(F.collect_list(some)).alias("codes"))
    known = known.withColumn("n", F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x["n"]))
    n, angle = F.col("n"), lambda x: x["c"] * (2 * 3.141592653589793 / period)
    total = lambda f: F.aggregate("codes", F.lit(0.0), lambda s, x: s + x["n"] * f(angle(x)))
    far = circular.wider(F.transform("codes", lambda x: x["c"]), tol, period)
    outcome = F.when(n == 0, "none").when(n == 1, "single").when(far, "conflict").otherwise("agree")
    merged = F.when(n == 1, F.element_at("codes", 1)["c"]).when((n > 1) & ~far, circular.code_of(total(F.cos), total(F.sin), period))
    return known.select(*keys, n.alias("n_known"), outcome.alias("outcome"), merged.cast("int").alias("code"))


def sum_votes(df: DataFrame, keys: list[str], classes: list[str], most: int = VOTE_MOST) -> DataFrame:
    """Votes of each class added up, saturating."""
    return df.groupBy(*keys).agg(*(F.least(F.sum(c), F.lit(most)).cast("int").alias(c) for c in classes))


def decide(first: Column, second: Column, least: int = 1, unanimous: bool = False) -> Column:
    """1 or 2, the class with more votes (or the only one); 0 if open."""
    if unanimous:
        return F.when((first >= least) & (second == 0), 1).when((second >= least) & (first == 0), 2).otherwise(0)
    return F.when((first > second) & (first >= least), 1).when((second > first) & (second >= least), 2).otherwise(0)


def fold_codes(df: DataFrame, keys: list[str], order: str, code: str, steps: int = CODE_STEPS, period: int = PERIOD) -> DataFrame:
    """The first known code of a cell in the given order; conflict (code null) as soon as a
    later one lies more than ``steps`` away."""
    rows = F.sort_array(F.collect_list(F.when(F.col(code).isNotNull(), F.struct(F.col(order).alias("o"), F.col(code).alias("c")))))
    held = df.groupBy(*keys).agg(rows.alias("rows"))
    first = F.element_at("rows", 1)["c"]
    clash = F.exists("rows", lambda r: F.abs(circular.code_diff(r["c"], first, period)) > steps)
    some = F.size("rows") > 0
    return held.select(*keys, F.when(some & ~clash, first).alias("code"), F.when(some, clash).otherwise(F.lit(False)).alias("conflict"))


def medoid(df: DataFrame, keys: list[str], code: str, weight: str, period: int = PERIOD) -> DataFrame:
    """The code of a cell with the least weighted sum of 1 - cos to all; ties go to the
    heavier, then to the smaller code.  Rows are added up by code first, so that a cell holds
    one entry a code, however many rows it has."""
    each = df.where(F.col(code).isNotNull()).groupBy(*keys, code).agg(F.sum(weight).alias("__w"), F.max(weight).alias("__m"))
    rows = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(code).alias("c"), F.col("__w").alias("w"), F.col("__m").alias("m")))).alias("rows"))
    angle = 2 * 3.141592653589793 / period
    cost = lambda a: F.round(F.aggregate("rows", F.lit(0.0), lambda s, b: s + b["w"] * (1 - F.cos((a["c"] - b["c"]) * angle))), 9)
    best = F.array_min(F.transform("rows", lambda a: F.struct(cost(a).alias("cost"), (-a["m"]).alias("w"), a["c"].alias("c"))))
    return rows.select(*keys, best["c"].alias("code"), best["cost"].alias("cost"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """First value whose cumulative weight passes half of the total; the midpoint to the
    next one where it meets half exactly."""
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    by = Window.partitionBy(*keys)
    run = by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = each.withColumns({"cum": F.sum("w").over(run), "total": F.sum("w").over(by), "next": F.lead(value).over(by.orderBy(value))})
    hit = F.when(F.col("cum") * 2 == F.col("total"), (F.col(value) + F.col("next")) / 2).otherwise(F.col(value))
    first = at.where(F.col("cum") * 2 >= F.col("total"))
    return first.groupBy(*keys).agg(F.min_by(hit, F.col(value)).cast("double").alias("median"))


def blend_tiles(df: DataFrame, keys: list[str], value: Column, place: Column, size: int, floor: float = 1e-6) -> DataFrame:
    """Overlapping values averaged by the squared sine of their place in the tile."""
    weight = F.greatest(F.pow(F.sin((place + 0.5) * (3.141592653589793 / size)), 2), F.lit(floor))
    return df.groupBy(*keys).agg((F.sum(weight * value) / F.sum(weight)).alias("value"))


def first_known(*columns: Column) -> Column:
    """Reference first, later sets only where all before are unknown."""
    return F.coalesce(*columns)
