"""Vote graphs: merging, energy, components, forests, chains and matching."""

from __future__ import annotations

import tempfile
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the cluster's checkpoint folder.  A folder of our own serves
    only where everything runs on one machine."""
    sc = df.sparkSession.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
    return df.checkpoint()


def merge_votes(votes: DataFrame) -> DataFrame:
    """Votes (a, b, d, w) turned so that a < b (d changes sign) and added up by (a, b, d)."""
    flip = F.col("a") > F.col("b")
    turned = votes.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(flip, -F.col("d")).otherwise(F.col("d")).alias("d"), "w")
    return turned.groupBy("a", "b", "d").agg(F.sum("w").alias("w"))


def l1_energy(votes: DataFrame, labels: DataFrame) -> DataFrame:
    """Sum of w * |s_b - s_a - d| under labels (node, s); rows without both labels count 0."""
    a = labels.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    b = labels.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    off = F.abs(F.col("sb") - F.col("sa") - F.col("d"))
    return votes.join(a, "a").join(b, "b").agg(F.sum(F.col("w") * off).cast("long").alias("energy"), F.sum(F.when(off == 0, F.col("w")).otherwise(0)).cast("long").alias("met"), F.sum("w").cast("long").alias("total"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node): labels go to neighbours and jump over their own
    labels, so that the rounds grow with the logarithm of the longest path."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = checkpoint(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l")))
    while True:
        near = both.join(label.select(F.col("u").alias("v"), F.col("l").alias("nl")), "v").groupBy("u").agg(F.min("nl").alias("nl"))
        lower = label.join(near, "u").select("u", F.least("l", "nl").alias("k"), "l")
        jump = lower.join(label.select(F.col("u").alias("k"), F.col("l").alias("kl")), "k", "left")
        new = checkpoint(jump.select("u", F.least("k", F.coalesce("kl", "k")).alias("n"), "l"))
        changed = new.where("n <> l").limit(1).count()
        label = new.select("u", F.col("n").alias("l"))
        if not changed:
            return label.select(F.col("u").alias("node"), F.col("l").alias("component"))


def mutual_best(edges: DataFrame, least: int = 1, ratio: float = 1.0) -> DataFrame:
    """Edges that are the heaviest of both ends, with at least ``least`` weight and the
    runner-up of either end below ``ratio`` of it; ties go to the smaller partner."""
    def top(end: str, other: str) -> DataFrame:
        w = Window.partitionBy(end).orderBy(F.desc("w"), other)
        return edges.withColumns({"r": F.row_number().over(w), "second": F.lead("w").over(w)}).where("r = 1").select("a", "b", F.coalesce("second", F.lit(0)).alias(f"second_{end}"))

    both = edges.join(top("a", "b"), ["a", "b"]).join(top("b", "a"), ["a", "b"])
    clear = (F.col("second_a") < F.col("w") * ratio) & (F.col("second_b") < F.col("w") * ratio) if ratio < 1 else F.lit(True)
    return both.where((F.col("w") >= least) & clear).select("a", "b", "w")


def spanning_forest(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Maximum spanning forest by rounds of heaviest outgoing edges (each component picks
    one, ties to the smaller pair); a round at least halves the number of components."""
    rank = F.struct(F.col("w").alias("w"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
    live = checkpoint(edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")).where("ca <> cb"))
    chosen = live.select("a", "b", "w").limit(0)
    for _ in range(rounds):
        if not live.limit(1).count():
            break
        out = live.select(F.explode(F.array("ca", "cb")).alias("c"), rank.alias("r")).groupBy("c").agg(F.max("r").alias("r"))
        picked = out.select((-F.col("r.a")).alias("a"), (-F.col("r.b")).alias("b"), F.col("r.w").alias("w")).distinct()
        chosen = checkpoint(chosen.unionByName(picked).distinct())
        joined = live.join(picked.select("a", "b"), ["a", "b"]).select("ca", "cb")
        part = components(joined, "ca", "cb")
        to = lambda c: part.select(F.col("node").alias(c), F.col("component").alias("n" + c))
        live = checkpoint(live.join(to("ca"), "ca", "left").join(to("cb"), "cb", "left").select("a", "b", "w", F.coalesce("nca", "ca").alias("ca"), F.coalesce("ncb", "cb").alias("cb")).where("ca <> cb"))
    return chosen


def chain_gauges(costs: DataFrame, keys: list[str], shifts: list[int], ties: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Exact integer gauges along chains: rows (keys, pos, prior, step) where prior is the
    preferred gauge of a link and step the preferred change from the link before; the sum
    of absolute deviations is least, ties to the smaller gauges.  Links follow each
    other by pos or the columns ``order``, those of one place by the columns ``ties``.  A chain is
    one row of arrays; chains of like length are solved side by side."""
    s = np.array(sorted(shifts), np.int64)

    def solve(prior: np.ndarray, step: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gauges and least sums of chains, one a row, padded at the end."""
        n, longest = prior.shape
        rest, choice = np.zeros((n, len(s)), np.int64), np.zeros((n, longest, len(s)), np.int32)
        # from the last link back, so that of equal sums the smaller gauges are found first
        for k in range(longest - 1, -1, -1):
            if k + 1 < longest:
                cost = np.abs(s[None, None, :] - s[None, :, None] - step[:, k + 1, None, None]) + rest[:, None, :]
                more = size > k + 1
                choice[:, k] = cost.argmin(2)
                rest = np.where(more[:, None], cost.min(2), 0)
            rest = np.where((size > k)[:, None], rest + np.abs(s[None, :] - prior[:, k, None]), 0)
        at, gauge = rest.argmin(1), np.zeros((n, longest), np.int64)
        for k in range(longest):
            gauge[:, k] = s[at]
            at = choice[np.arange(n), k, at]
        return gauge, rest.min(1)

    def run(batches):
        for x in batches:
            size = x["prior"].map(len).to_numpy()
            gauges, sums = [None] * len(x), np.zeros(len(x))
            for level in np.unique(np.frexp(size)[1]):  # padded to twice their length at most
                whole = np.flatnonzero(np.frexp(size)[1] == level)
                few = max(1, 4_000_000 // (int(size[whole].max()) * len(s)))
                for rows in np.split(whole, range(few, len(whole), few)):
                    wide = int(size[rows].max())
                    pad = lambda c: np.stack([np.pad(np.asarray(v, np.int64), (0, wide - len(v))) for v in x[c].iloc[rows]])  # noqa: B023, E731
                    got, least = solve(pad("prior"), pad("step"), size[rows])
                    sums[rows] = least
                    for r, g in zip(rows.tolist(), got, strict=True):
                        gauges[r] = g[: size[r]]
            yield x[[*keys, "pos"]].assign(gauge=gauges, cost=sums)

    kinds = dict(costs.dtypes)
    chains = costs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*(order or []), "pos", *(ties or []), "prior", "step"))).alias("c"))
    chains = chains.select(*keys, *(F.col(f"c.{f}").alias(f) for f in ("pos", "prior", "step")))
    solved = chains.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", pos array<{kinds['pos']}>, gauge array<long>, cost double")
    return solved.select(*keys, F.explode(F.arrays_zip("pos", "gauge")).alias("l"), "cost").select(*keys, "l.pos", "l.gauge", "cost")


def greedy_links(candidates: DataFrame) -> DataFrame:
    """One-to-one links by rising cost: in each round the links that are cheapest for both
    ends are taken and their ends closed; the result equals going through all in order."""
    live, taken = checkpoint(candidates.select("a", "b", "cost")), candidates.select("a", "b", "cost").limit(0)
    while live.limit(1).count():
        low = lambda e: live.groupBy(e).agg(F.min(F.struct("cost", "a", "b")).alias("m")).select(F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.cost").alias("cost"))
        both = checkpoint(low("a").intersect(low("b")))
        taken = checkpoint(taken.unionByName(both))
        live = checkpoint(live.join(both.select("a"), "a", "left_anti").join(both.select("b"), "b", "left_anti"))
    return taken


def end_links(pieces: DataFrame, gap: float, cos_least: float, lateral: float, reach: float | None = None) -> DataFrame:
    """Candidate links between ends of pieces: rows (run, end, family, x, y, z, tx, ty, tz)
    with unit tangents that point outward.  Ends of unlike runs of one family link if they
    are within the gap, face each other, and lie near each other's tangent line; the cost
    adds up the three shares.  Ends are looked for within the gap or a smaller
    reach, and dealt into cells of four reaches and those that they reach."""
    c, axes = F.col, "xyz"
    reach = gap if reach is None else reach
    names = [f"__c{a}" for a in axes]
    left = pieces.select(*(c(k).alias(f"{k}_a") for k in pieces.columns), *(F.floor(c(a) / (4 * reach)).alias(n) for a, n in zip(axes, names, strict=True)))
    right = pieces.select(*(c(k).alias(f"{k}_b") for k in pieces.columns))
    for a, n in zip(axes, names, strict=True):
        low, high = (F.floor((c(f"{a}_b") + d * reach * 1.000001) / (4 * reach)) for d in (-1, 1))
        right = right.withColumn(n, F.explode(F.sequence(low, high)))
    first = F.struct("run_a", "end_a") < F.struct("run_b", "end_b")
    meet = [left[n] == right[n] for n in names]
    both = left.join(right, [*meet, c("family_a") == c("family_b"), c("run_a") != c("run_b"), first])
    dot = lambda p, q: sum((p(a) * q(a) for a in axes), F.lit(0.0))
    v, ta, tb = (lambda a: c(f"{a}_b") - c(f"{a}_a")), (lambda a: c(f"t{a}_a")), (lambda a: c(f"t{a}_b"))
    both = both.withColumns({"g": F.sqrt(dot(v, v)), "face": -dot(ta, tb), "pa": dot(v, ta), "pb": -dot(v, tb)})
    off = lambda p: F.sqrt(F.greatest(F.lit(0.0), c("g") * c("g") - c(p) * c(p)))
    both = both.withColumn("lat", F.greatest(off("pa"), off("pb")))
    ahead = (c("g") < 2) | ((c("pa") >= cos_least * c("g")) & (c("pb") >= cos_least * c("g")))
    good = both.where((c("g") <= reach) & (c("face") >= cos_least) & ahead & (c("lat") <= lateral))
    return good.select("run_a", "end_a", "run_b", "end_b", (c("g") / gap + (1 - c("face")) / (1 - cos_least) + c("lat") / lateral).alias("cost"), "g", "lat")


def chain_links(links: DataFrame) -> DataFrame:
    """Links (run_a, end_a, run_b, end_b, cost) taken by rising cost, so that every end has
    one mate at most and no chain closes on itself.  Columns ca and cb may name chains that
    runs belong to already.

    A round takes the links that are the cheapest of both chains they join: whatever could
    come between them later costs more, so the result equals going through all in order."""
    ends = ["run_a", "end_a", "run_b", "end_b"]
    order = F.struct("cost", *ends)
    chain = {f"c{s}": F.coalesce(f"c{s}", f"run_{s}") if f"c{s}" in links.columns else F.col(f"run_{s}") for s in "ab"}
    live = checkpoint(links.withColumns(chain).select(*ends, "cost", "ca", "cb").where("ca <> cb"))
    taken = live.select(*ends, "cost").limit(0)
    while live.limit(1).count():
        low = live.select(F.explode(F.array("ca", "cb")).alias("chain"), order.alias("o")).groupBy("chain").agg(F.min("o").alias("o"))
        # a chain takes one link a round, so that chains join in pairs
        both = checkpoint(low.groupBy("o").agg(F.count("*").alias("n"), F.min("chain").alias("into"), F.max("chain").alias("chain")).where("n = 2").select("o.*", "into", "chain"))
        taken = taken.unionByName(both.select(*ends, "cost"))
        for side in "ab":
            shut = both.select(F.inline(F.array(*(F.struct(F.col(f"run_{s}").alias(f"run_{side}"), F.col(f"end_{s}").alias(f"end_{side}")) for s in "ab"))))
            live = live.join(shut, [f"run_{side}", f"end_{side}"], "left_anti")
            live = live.join(both.select(F.col("chain").alias(f"c{side}"), F.col("into").alias("__into")), f"c{side}", "left").withColumn(f"c{side}", F.coalesce("__into", f"c{side}")).drop("__into")
        live = checkpoint(live.where("ca <> cb"))
    return taken


def chain_ends(pieces: DataFrame, gap: float, cos_least: float, lateral: float) -> DataFrame:
    """chain_links of end_links, without all candidates at once.

    A link of gap g costs at least g of the whole gap.  So ends within a small reach are
    looked for first, and of their links those are taken that cost no more than any link
    further off; then the reach doubles, for the ends that are left open.  Where every run has
    one end, no chain can close, and cells settle their links by themselves.  Ends without a
    finite place and tangent link with nothing."""
    from gridloom.operators.joins import first_ring
    from gridloom.operators.matching import match_ends

    finite = [F.abs(F.col(k)) < float("inf") for k in ("x", "y", "z", "tx", "ty", "tz")]
    pieces = checkpoint(pieces.dropna(subset=["run", "end", "family"]).where(reduce(and_, finite)))
    if cos_least < 1 and not pieces.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return match_ends(pieces, gap, cos_least, lateral)
    open_ends, reach = pieces, first_ring(pieces, list("xyz"), gap)
    taken = None
    while True:
        links = end_links(open_ends, gap, cos_least, lateral, reach)
        if reach < gap:
            links = links.where(F.col("cost") <= reach / gap - 1e-6)  # unit tangents are so but for rounding
        if taken is not None:
            part = components(taken, "run_a", "run_b")
            for side in "ab":
                links = links.join(part.select(F.col("node").alias(f"run_{side}"), F.col("component").alias(f"c{side}")), f"run_{side}", "left")
        new = chain_links(links)
        taken = new if taken is None else checkpoint(taken.unionByName(new))
        if reach >= gap:
            return taken
        shut = new.select(F.inline(F.array(*(F.struct(F.col(f"run_{s}").alias("run"), F.col(f"end_{s}").alias("end")) for s in "ab"))))
        open_ends, reach = checkpoint(open_ends.join(shut, ["run", "end"], "left_anti")), reach * 2
