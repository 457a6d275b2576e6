"""Metric tables: means, stratified bootstrap intervals and paired differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.hashing import nth_random

#: A metric table of so many boxes goes to every task; a larger one is dealt.
HELD = 100_000
#: Of a larger one a task holds so many boxes of a stratum, for one of so many shares of the
#: draws; it goes through the numbers of its whole stratum and takes those that fall to it.
CHUNK, SHARES = 1 << 18, 16


def clean_set(df: DataFrame, ceil: str | None, least: float) -> DataFrame:
    """Boxes whose ceiling is at least ``least``; boxes without a ceiling stay."""
    if ceil is None:
        return df
    c = F.col(ceil)
    return df.where(c.isNull() | F.isnan(c) | (c >= least))


def _boxes(a: DataFrame, b: DataFrame | None, box: str, stratum: str, metric: str) -> DataFrame:
    """pos, cnt, first, va, vb of the boxes with a value in both tables: strata follow each
    other in order of their first box, boxes in order of their name."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    rows = a.select(F.col(box).alias("box"), F.col(stratum).alias("stratum"), F.col(metric).cast("double").alias("va")).where(fine(F.col("va")))
    if b is not None:
        other = b.select(F.col(box).alias("box"), F.col(metric).cast("double").alias("vb")).where(fine(F.col("vb")))
        rows = rows.join(other, "box")
    else:
        rows = rows.withColumn("vb", F.lit(None).cast("double"))
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("cnt"), F.min("box").alias("lead"))
    ahead = Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)  # one row a stratum
    sizes = sizes.withColumn("first", F.coalesce(F.sum("cnt").over(ahead), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("box")) - 1
    return rows.join(sizes, "stratum").withColumn("pos", F.col("first") + place).select("pos", "cnt", "first", "va", "vb")


def bootstrap(a: DataFrame, b: DataFrame | None, box: str, stratum: str, metric: str, draws: int = 10_000, seed: int = 1, held: int = HELD) -> DataFrame:
    """draw, ma, mb: means over as many boxes of each stratum as it has, drawn with
    replacement by the numbers of splitmix64 in order of draws and boxes."""
    rows = _boxes(a, b, box, stratum, metric)
    spark, n = a.sparkSession, rows.count()
    if not n:
        return spark.createDataFrame([], "draw long, ma double, mb double")
    if n > held:
        share = -(-draws // SHARES)

        def part(x: pd.DataFrame) -> pd.DataFrame:
            """What some draws of a stratum take from a chunk of it."""
            x = x.sort_values("pos")
            first, cnt, low, s = (int(x[k].iloc[0]) for k in ("first", "cnt", "pos", "share"))
            va, vb, sums = x["va"].to_numpy(float), x["vb"].to_numpy(float), []
            for k in range(share * s, min(draws, share * (s + 1))):
                sa = sb = 0.0
                for at in range(first, first + cnt, CHUNK):
                    r = nth_random(seed, k * n + np.arange(at, min(at + CHUNK, first + cnt)) + 1) % np.uint64(cnt)
                    pos = first + r.astype(np.int64) - low
                    pos = pos[(pos >= 0) & (pos < len(va))]
                    sa, sb = sa + va[pos].sum(), sb + vb[pos].sum()
                sums.append((k, sa, sb))
            return pd.DataFrame(sums, columns=["draw", "sa", "sb"])

        shares = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // share)))
        chunks = rows.withColumns({"chunk": F.floor((F.col("pos") - F.col("first")) / CHUNK), "share": shares})
        sums = chunks.groupBy("first", "chunk", "share").applyInPandas(part, "draw long, sa double, sb double")
        return sums.groupBy("draw").agg((F.sum("sa") / n).alias("ma"), F.when(F.lit(b is not None), F.sum("sb") / n).alias("mb"))
    table = rows.orderBy("pos").toPandas()  # at most `held` rows of five numbers
    sent = spark.sparkContext.broadcast([table[k].to_numpy() for k in ("cnt", "first", "va", "vb")])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cnt, first, va, vb = sent.value
        at = np.arange(n)
        for x in batches:
            means = []
            for k in x["id"].to_numpy(np.int64):
                pos = first + (nth_random(seed, k * n + at + 1) % cnt.astype(np.uint64)).astype(np.int64)
                means.append((va[pos].sum() / n, vb[pos].sum() / n))
            m = np.array(means).reshape(-1, 2)
            yield pd.DataFrame({"draw": x["id"], "ma": m[:, 0], "mb": m[:, 1]})

    return spark.range(draws).mapInPandas(draw, "draw long, ma double, mb double").withColumn("mb", F.nanvl("mb", F.lit(None).cast("double")))


def intervals(a: DataFrame, b: DataFrame, box: str, stratum: str, metric: str, **more) -> DataFrame:
    """One row: boxes, both means and their 95 % intervals, the difference and its interval,
    the share of draws in which a is above b, and the least difference that would show."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    d = bootstrap(a, b, box, stratum, metric, **more).withColumn("md", F.col("ma") - F.col("mb"))
    drawn = d.agg(*(q(m, p).alias(f"{m}_{k}") for m in ("ma", "mb", "md") for k, p in (("lo", 0.025), ("hi", 0.975))), F.avg(F.when(F.col("md") > 0, 1.0).otherwise(0.0)).alias("p_above"), (2.8 * F.stddev_samp("md")).alias("mde"))
    means = _boxes(a, b, box, stratum, metric).agg(F.count("*").alias("n"), F.avg("va").alias("a"), F.avg("vb").alias("b"))
    return means.crossJoin(F.broadcast(drawn)).withColumn("diff", F.col("a") - F.col("b"))  # one row each
