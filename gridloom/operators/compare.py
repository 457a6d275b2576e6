"""Modes, agreements and comparisons of groups and of pairs of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.fields import known, ramp


def modes(counts: DataFrame, keys: list[str], value: list[str], n: str = "n") -> DataFrame:
    """The most frequent value of each key (ties to the smaller), its count, share, and the
    count of the runner-up; counts holds one row a key and value."""
    w = Window.partitionBy(*keys).orderBy(F.desc(n), *value) if keys else Window.orderBy(F.desc(n), *value)  # without keys: as many rows as values
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumns({"__i": F.row_number().over(w), "second": F.coalesce(F.lead(n).over(w), F.lit(0)), "__total": F.sum(n).over(whole)})
    return ranked.where("__i = 1").select(*keys, *value, n, (F.col(n) / F.col("__total").cast("double")).alias("share"), "second")


def mode_counts(df: DataFrame, keys: list[str], **value: Column) -> DataFrame:
    cells = df.select(*keys, *(c.alias(k) for k, c in value.items()))
    return cells.groupBy(*keys, *value).agg(F.count("*").alias("n"))


def purity(counts: DataFrame, key: str) -> DataFrame:
    """Share of rows in the mode of their key, summed over keys; and the mean over keys."""
    by = counts.groupBy(key).agg(F.max("n").alias("__top"), F.sum("n").alias("__n"))
    return by.agg((F.sum("__top").cast("double") / F.sum("__n")).alias("ids"), F.avg(F.col("__top") / F.col("__n").cast("double")).alias("purity"), F.sum("__n").alias("matched"), F.count("*").alias("groups"))


def calibration(df: DataFrame, bin_: Column, truth: str) -> DataFrame:
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(truth).alias("p_right"))


def winding_delta(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Mean absolute difference of two fields where both have a value, and how often they
    snap to the same whole number."""
    both = a.select(key, F.col(value).alias("__a")).join(b.select(key, F.col(value).alias("__b")), key).where("__a is not null and __b is not null")
    same = F.floor(F.col("__a") + 0.5) == F.floor(F.col("__b") + 0.5)
    return both.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("__a") - F.col("__b"))).alias("delta"), F.avg(known(same)).alias("snap"))


def error_and_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(F.abs(F.col(a) - F.col(b))).alias("err"), F.corr(a, b).alias("r"))


def correlations(df: DataFrame, key: str, a: Column, b: Column, least: int = 4) -> DataFrame:
    """Pearson's r of each group with at least so many finite pairs."""
    fine = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    return df.where(fine).groupBy(key).agg(F.corr(a, b).alias("r"), F.count("*").alias("n")).where(F.col("n") >= least)


def coherence_weight(df: DataFrame, cell: Column, a: Column, b: Column, low: float, width: float) -> DataFrame:
    r = df.groupBy(cell.alias("cell")).agg(F.corr(a, b).alias("r")).where("r is not null")
    return r.withColumn("w", ramp(F.col("r"), low, width))


def group_summary(df: DataFrame, key: str, value: str, cut: float, other: Column) -> DataFrame:
    """Mean, share at or above a cut, and correlation with another column."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.avg(known(F.col(value) >= cut)).alias("frac"), F.corr(F.col(value), other).alias("r"))


def coverage(df: DataFrame, group: str, key: str, held: DataFrame) -> DataFrame:
    """Rows of a group, and how many of them a held-out set covers."""
    mark = held.select(key).distinct().withColumn("__held", F.lit(1))
    rows = df.join(mark, key, "left")
    return rows.groupBy(group).agg(F.count("*").alias("cells"), F.count("__held").alias("held"), F.avg(known(F.col("__held").isNotNull())).alias("share"))


def group_auc(df: DataFrame, group: list[str], score: str, truth: str) -> DataFrame:
    """Area under the ROC curve of each group from its class counts a score, ties half; null
    where a class is missing.  The counts of a group are as few as its scores."""
    hist = df.where(F.col(truth).isNotNull()).groupBy(*group, score).agg(F.count_if(F.col(truth) == 1).alias("__pos"), F.count_if(F.col(truth) == 0).alias("__neg"))
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = hist.withColumn("__below", F.coalesce(F.sum("__neg").over(w), F.lit(0)))
    pos, neg = F.sum("__pos"), F.sum("__neg")
    return below.groupBy(*group).agg(pos.alias("pos"), neg.alias("neg"), F.when(pos * neg > 0, F.sum(F.col("__pos") * (F.col("__below") + F.col("__neg") * 0.5)) / (pos * neg).cast("double")).alias("auc"))


def ratio_bins(df: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """Mean log2 of count over mean, of keys binned by their mean."""
    r = df.groupBy(key).agg(F.count("*").alias("__n"), F.avg(value).alias("__s"))
    return r.groupBy(F.floor(F.col("__s") / width).alias("bin")).agg(F.count("*").alias("cells"), F.avg(F.log2(F.col("__n") / F.col("__s"))).alias("ratio"))


def resultant_score(df: DataFrame, keys: list[Column], code: str, least: int) -> DataFrame:
    """Signed share of the summed direction, of groups with enough rows."""
    from gridloom.functions.circular import phasor

    c, s = phasor(F.col(code))
    return df.where(F.col(code).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(c) / F.sum(F.sqrt(c * c + s * s))).alias("score")).where(F.col("n") >= least)


def top(parts: list[tuple[str, DataFrame, Column, Column]], n: int) -> DataFrame:
    """The n worst rows of several tables: parts of (kind, table, id, badness)."""
    out = None
    for kind, df, key, bad in parts:
        one = df.select(F.lit(kind).alias("kind"), key.cast("long").alias("id"), bad.cast("double").alias("badness"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("badness"), "kind", "id").limit(n)
