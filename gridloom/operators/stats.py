"""Histograms, thresholds, ranks, correlations and bootstrap.

Scores are bytes 0..255, so counters come from one grouping into at most 256 rows a key
and windows over those, however many rows went in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.graph import checkpoint


def _by(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def class_histogram(df: DataFrame, value: str, truth: str, keys: list[str] | None = None) -> DataFrame:
    """value, pos, neg counts; rows of unknown truth enter none."""
    return df.where(F.col(truth).isNotNull() & F.col(value).isNotNull()).groupBy(*(keys or []), value).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))


def counters(hist: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """tp and fp of "value and above", and the totals, from a class histogram."""
    by = _by(keys or [])
    up = by.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumns({"tp": F.sum("pos").over(up), "fp": F.sum("neg").over(up), "n_pos": F.sum("pos").over(by), "n_neg": F.sum("neg").over(by)})


def at_thresholds(hist: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """precision, recall, F1 at shares of 255, truncated to bytes."""
    spark = hist.sparkSession
    cuts = spark.createDataFrame([(t, int(t * 255)) for t in thresholds], "thr double, cut int")
    got = cuts.join(hist, F.col(value) >= F.col("cut"), "left").groupBy("thr", "cut").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    total = hist.agg(F.sum("pos").alias("n_pos"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", "n_pos")
    scored = got.join(F.broadcast(total)).withColumns({"precision": p, "recall": r})
    return scored.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auc_from_histogram(hist: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half."""
    keys = keys or []
    below = _by(keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    part = hist.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return part.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))), F.sum("pos") * F.sum("neg")).alias("auc"))


def best_f1(hist: DataFrame, value: str) -> DataFrame:
    """The threshold of the highest F1, the first of ties."""
    c = counters(hist, value).withColumn("f1", F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos")))
    best = c.agg(F.max(F.struct(F.round("f1", 12).alias("f1"), (-F.col(value)).alias("t"))).alias("b"))
    return best.select(F.col("b.f1").alias("f1"), (-F.col("b.t")).alias("threshold"))


def quantile_of_histogram(hist: DataFrame, value: str, count: str, q: float) -> DataFrame:
    """Smallest value whose cumulative count reaches q of the total; 255 if there is none."""
    cum = F.sum(count).over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = hist.where(F.col(count) > 0).withColumns({"cum": cum, "total": F.sum(count).over(Window.partitionBy())})
    return rows.agg(F.coalesce(F.min(F.when(F.col("cum") >= q * F.col("total"), F.col(value))), F.lit(255)).alias("value"))


def otsu(hist: DataFrame, value: str, count: str) -> DataFrame:
    """Cut of the largest between-class variance; the middle of a plateau."""
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    rows = hist.withColumns({"n": F.sum(count).over(w), "s": F.sum(F.col(count) * F.col(value)).over(w), "tn": F.sum(count).over(all_), "ts": F.sum(F.col(count) * F.col(value)).over(all_)})
    gap = F.try_divide(F.col("s"), F.col("n")) - F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"))
    var = F.round(F.coalesce(F.col("n") * (F.col("tn") - F.col("n")) * gap * gap, F.lit(0.0)) / F.pow("tn", 2), 9)
    best = rows.withColumn("var", var).withColumn("top", F.max("var").over(all_))
    return best.where(F.col("var") == F.col("top")).agg(F.floor((F.min(value) + F.max(value)) / 2).cast("long").alias("cut"), F.max("var").alias("variance"))


def average_ranks(df: DataFrame, value: str, keys: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Ranks with ties averaged, from one row a distinct value.

    Without keys the distinct values are dealt by range, summed up within each range and
    shifted by the totals of the ranges before, so that no task holds them all."""
    keys = keys or []
    each = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    if keys:
        before = F.coalesce(F.sum("__n").over(_by(keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = each.select(*keys, value, (before + (F.col("__n") + 1) / 2.0).alias(out))
        return df.join(ranks, [*keys, value])
    dealt = checkpoint(each.repartitionByRange(value).withColumn("__p", F.spark_partition_id()))
    totals = dealt.groupBy("__p").agg(F.sum("__n").alias("__t"))  # one row a range
    shift = totals.select("__p", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = dealt.withColumn("__b", before).join(F.broadcast(shift), "__p").select(value, (F.col("__s") + F.col("__b") + (F.col("__n") + 1) / 2.0).alias(out))
    return df.join(ranks, value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df.select(a, b), a, out="__ra"), b, out="__rb")
    return ranked.agg(F.corr("__ra", "__rb").alias("spearman"))


def partial_correlation(ab: str, ac: str, bc: str):
    """Correlation of a and b with c held fixed, from three columns of correlations."""
    return (F.col(ab) - F.col(ac) * F.col(bc)) / F.sqrt((1 - F.pow(ac, 2)) * (1 - F.pow(bc, 2)))


def bootstrap_means(df: DataFrame, stratum: str, value: str, draws: int, seed: int) -> DataFrame:
    """Stratified bootstrap means: each draw takes as many rows of a stratum as it has.

    Choices are hashes of (seed, draw, stratum, place), the same on any cluster."""
    order = Window.partitionBy(stratum).orderBy(value)
    rows = df.withColumns({"__i": F.row_number().over(order) - 1, "__n": F.count("*").over(Window.partitionBy(stratum))})
    picks = rows.select(stratum, "__i", "__n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picks = picks.withColumn("__i", F.pmod(F.xxhash64(F.lit(seed), "draw", stratum, "__i"), F.col("__n")).cast("int"))
    return picks.join(rows.select(stratum, "__i", value), [stratum, "__i"]).groupBy("draw").agg(F.avg(value).alias("mean"))


def covariance(df: DataFrame, vector: str) -> np.ndarray:
    """Covariance of the components of equally long vectors: each task sends one Gram matrix,
    dimension squared numbers; vectors with unknown components are left out."""
    v = F.col(vector)
    rows = df.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))).select(v.cast("array<double>").alias("v"))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, 0.0, 0.0
        for x in batches:
            m = np.stack(x["v"].to_numpy()) if len(x) else np.zeros((0, 1))
            n, total, square = n + len(m), total + m.sum(0), square + m.T @ m
        if n:
            yield pd.DataFrame({"i": np.arange(len(total)), "n": n, "total": total, "row": list(square)})

    each = rows.mapInPandas(gram, "i int, n long, total double, row array<double>")
    got = each.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.collect_list("row").alias("rows")).orderBy("i").select("n", "total", F.expr("aggregate(slice(rows, 2, size(rows)), rows[0], (a, r) -> zip_with(a, r, (x, y) -> x + y))").alias("row")).toPandas()
    if not len(got):
        return np.zeros((0, 0))
    n, mean = int(got["n"][0]), got["total"].to_numpy() / got["n"][0]
    return np.stack(got["row"].to_numpy()) / n - np.outer(mean, mean)


def project(df: DataFrame, vector: str, mean: list[float], axes: list[list[float]], out: str = "projected") -> DataFrame:
    """Vectors less their mean, on each axis."""
    off = F.zip_with(F.col(vector).cast("array<double>"), F.array(*(F.lit(float(m)) for m in mean)), lambda x, m: x - m)
    on = lambda axis: F.aggregate(F.zip_with(off, F.array(*(F.lit(float(a)) for a in axis)), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(out, F.array(*(on(a) for a in axes)))
