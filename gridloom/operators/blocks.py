"""Areas under ROC curves with intervals from resampled blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.hashing import nth_random
from gridloom.operators.scratch import Scratch, numbered

c = F.col
#: Draws of one task, and blocks whose histograms it holds at once.
DRAWS, BLOCKS = 250, 4096


def picks(seed: int, blocks: int) -> np.ndarray:
    """How often each block is drawn, of as many draws as there are blocks: the upper half
    of the product of a random 64-bit number and their count."""
    x = nth_random(seed, np.arange(1, blocks + 1))
    n = np.uint64(blocks)
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    return np.bincount(((high * n + ((low * n) >> np.uint64(32))) >> np.uint64(32)).astype(np.int64), minlength=blocks)


def area(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Areas of rows of two histograms, ties counted half."""
    below = np.cumsum(neg, -1) - neg
    with np.errstate(invalid="ignore", divide="ignore"):
        return (pos * (below + 0.5 * neg)).sum(-1) / (pos.sum(-1) * neg.sum(-1))


def block_bootstrap(rows: DataFrame, reference: str, draws: int = 1000, seed: int = 0x5EED0000, scratch: Scratch | None = None) -> DataFrame:
    """model, n, auc, delta, low, high: areas of each model, how far they are above the
    reference's, and the central 95 % of that over draws of whole blocks.

    rows: block, model, value (0..255), truth (0 or 1).  Blocks are numbered in order; draw
    d takes as many blocks as there are, with replacement, by the random sequence of seed
    + d, for all models alike.  A draw is a weighted sum of the blocks' class histograms,
    never a new ranking: tasks add up some draws over some blocks."""
    scratch = scratch or Scratch(rows.sparkSession)
    known = rows.where("value is not null and truth is not null")
    hist = scratch.save(known.groupBy("block", "model", c("truth").cast("int").alias("truth"), c("value").cast("int").alias("value")).agg(F.count("*").alias("n")))
    number = scratch.save(numbered(hist.select("block").distinct(), "no", "block", scratch=scratch))
    blocks = number.count()
    plain = hist.groupBy("model", "truth", "value").agg(F.sum("n").alias("n"))

    def tall(x: pd.DataFrame) -> np.ndarray:
        both = np.zeros((2, 256))
        np.add.at(both, (x["truth"].to_numpy(), x["value"].to_numpy()), x["n"].to_numpy(float))
        return both

    def whole(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        neg, pos = tall(x)
        return pd.DataFrame({"model": [key[0]], "n": [int(x["n"].sum())], "auc": [float(area(pos, neg))]})

    base = scratch.save(plain.groupBy("model").applyInPandas(whole, "model string, n long, auc double"))

    def some(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        mine = range(key[0] * DRAWS, min((key[0] + 1) * DRAWS, draws))
        at = np.unique(x["no"].to_numpy())
        weight = np.stack([picks(seed + d, blocks)[at] for d in mine]).astype(float)
        out = []
        for model, y in x.groupby("model"):
            table = np.zeros((len(at), 512))
            np.add.at(table, (np.searchsorted(at, y["no"].to_numpy()), y["truth"].to_numpy() * 256 + y["value"].to_numpy()), y["n"].to_numpy(float))
            out += [(d, model, s) for d, s in zip(mine, weight @ table, strict=True)]
        return pd.DataFrame(out, columns=["draw", "model", "sums"])

    chunks = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // DRAWS) - 1))).alias("chunk")
    dealt = hist.join(number, "block").select("no", "model", "truth", "value", "n", chunks).withColumn("part", F.floor(c("no") / BLOCKS))
    sums = dealt.groupBy("chunk", "part").applyInPandas(some, "draw long, model string, sums array<double>")

    def areas(x: pd.DataFrame) -> pd.DataFrame:
        s = x.groupby(["draw", "model"])["sums"].agg(lambda rows: np.stack(rows.to_list()).sum(0)).reset_index()
        both = np.stack(s["sums"].to_list())
        return s[["draw", "model"]].assign(auc=area(both[:, 256:], both[:, :256]))

    drawn = scratch.save(sums.groupBy(F.floor(c("draw") / DRAWS)).applyInPandas(areas, "draw long, model string, auc double"))
    against = drawn.join(drawn.where(c("model") == reference).select("draw", c("auc").alias("ref")), "draw").withColumn("delta", c("auc") - c("ref"))
    ends = against.groupBy("model").agg(F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"))
    ref = base.where(c("model") == reference).select(c("auc").alias("ref"))
    other = F.when(c("model") != reference, 1)
    return base.crossJoin(F.broadcast(ref)).join(ends, "model").select("model", "n", "auc", (other * (c("auc") - c("ref"))).alias("delta"), (other * c("low")).alias("low"), (other * c("high")).alias("high"))
