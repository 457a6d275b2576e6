"""Ordered computations: prefix sums, runs, smoothing, peaks and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.circular import wrap_turn


def _over(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)


def islands(df: DataFrame, keys: list[str], order: list[str], same: Column) -> DataFrame:
    """Adds ``run``: rows of a key in order start a new run where ``same`` (which may look
    back with lag over (keys, order)) is not true."""
    w = _over(keys, *order)
    new = df.withColumn("__new", F.when(same, 0).otherwise(1))
    return new.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def runs_of(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Run lengths of equal values: keys, value, run, length."""
    w = _over(keys, *order)
    marked = islands(df.withColumn("__before", F.lag(value).over(w)), keys, order, F.col("__before") == F.col(value))
    return marked.groupBy(*keys, "run", value).agg(F.count("*").alias("length"))


def box_mean(df: DataFrame, keys: list[str], order: str, value: str, reach: int) -> Column:
    return F.avg(value).over(_over(keys, order).rowsBetween(-reach, reach))


def local_peaks(df: DataFrame, keys: list[str], order: list[str], value: str, least: float) -> DataFrame:
    """Rows at least ``least`` that exceed the row before and are not below the next."""
    w = _over(keys, *order)
    rows = df.withColumns({"__p": F.lag(value).over(w), "__n": F.lead(value).over(w)})
    up = F.col("__p").isNull() | (F.col(value) > F.col("__p"))
    top = F.col("__n").isNull() | (F.col(value) >= F.col("__n"))
    return rows.where((F.col(value) >= least) & up & top).drop("__p", "__n")


def unwrap(df: DataFrame, keys: list[str], order: list[str], turn: str, out: str = "unwrapped") -> DataFrame:
    """Running sum of wrapped differences, from 0 at the first row of a key."""
    w = _over(keys, *order)
    step = df.withColumn("__d", F.coalesce(wrap_turn(F.col(turn) - F.lag(turn).over(w)), F.lit(0.0)))
    return step.withColumn(out, F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__d")


def switches(df: DataFrame, keys: list[str], order: str, value: str, slack: float) -> DataFrame:
    """Hysteresis along a line: the baseline starts at the first value; when a value leaves
    it by more than ``slack``, it moves by the rounded difference, which is counted.  One
    array a line is folded, since each step depends on the one before."""
    line = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("rows"))
    start = F.struct(F.element_at("rows", 1)["v"].alias("base"), F.lit(0.0).alias("turns"))

    def step(a: Column, r: Column) -> Column:
        k = F.when(F.abs(r["v"] - a["base"]) > slack, F.rint(r["v"] - a["base"])).otherwise(0.0)
        return F.struct((a["base"] + k).alias("base"), (a["turns"] + F.abs(k)).alias("turns"))

    return line.select(*keys, F.size("rows").cast("long").alias("n"), F.aggregate("rows", start, step, lambda a: a["turns"]).alias("switches"))


def median_filter(df: DataFrame, keys: list[str], order: str, value: str, reach: int, least: int = 1) -> Column:
    """Upper median of the known values within reach; null below ``least`` of them."""
    near = F.sort_array(F.collect_list(value).over(_over(keys, order).rowsBetween(-reach, reach)))
    return F.when(F.size(near) >= least, F.element_at(near, F.floor(F.size(near) / 2).cast("int") + 1))
