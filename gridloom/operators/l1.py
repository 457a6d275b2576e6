"""Least-cost integer potentials: labels s that lower the sum of w * |s_b - s_a - d|.

Votes (a, b, d, w) may be one-sided: ``wn`` is the price of a unit below d, w above it.
The sum is convex in each difference, so that moves by a step on a set of nodes, chosen by
a minimum cut, end at the least sum there is.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.graph import components
from gridloom.operators.scratch import Scratch

c = F.col
#: Nodes of one minimum cut; a component of more is cut into blocks.
BLOCK = 2000
#: A large component is cut anew until so many cuts in a row lower its sum by less than one
#: in ``FALL``.
CUTS, FALL = 3, 1000


def merge_votes(votes: DataFrame) -> DataFrame:
    """Votes turned so that a < b and added up by (a, b, d): a, b, d, w, wn."""
    flip = c("a") > c("b")
    wn = c("wn") if "wn" in votes.columns else c("w")
    both = votes.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(flip, -c("d")).otherwise(c("d")).cast("long").alias("d"), F.when(flip, wn).otherwise(c("w")).cast("long").alias("w"), F.when(flip, c("w")).otherwise(wn).cast("long").alias("wn"))
    return both.groupBy("a", "b", "d").agg(F.sum("w").alias("w"), F.sum("wn").alias("wn"))


def cost(r: np.ndarray, w: np.ndarray, wn: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, w * r, -wn * r)


def energy(votes: DataFrame, labels: DataFrame) -> DataFrame:
    """energy of labels (node, s) under merged votes."""
    on = lambda x: labels.select(c("node").alias(x), c("s").alias(f"s{x}"))
    r = c("sb") - c("sa") - c("d")
    return votes.join(on("a"), "a").join(on("b"), "b").agg(F.coalesce(F.sum(F.when(r >= 0, c("w") * r).otherwise(-c("wn") * r)), F.lit(0)).alias("energy"))


def minimum_cut(n: int, a: np.ndarray, b: np.ndarray, cap: np.ndarray, source: np.ndarray, sink: np.ndarray) -> np.ndarray:
    """Which of n nodes are on the source's side of a minimum cut: arcs a -> b of capacity
    cap, and for each node an arc from the source and one to the sink.  Augments along
    shortest paths, level by level."""
    arcs: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[int] = []

    def add(u: int, v: int, x: int) -> None:
        if x > 0:
            arcs[u].append(len(head))
            arcs[v].append(len(head) + 1)
            head.extend((v, u))
            room.extend((x, 0))

    for u, v, x in zip(a.tolist(), b.tolist(), cap.tolist(), strict=True):
        add(u, v, x)
    for v in range(n):
        both = min(int(source[v]), int(sink[v]))
        add(n, v, int(source[v]) - both)
        add(v, n + 1, int(sink[v]) - both)
    while True:
        level = [-1] * (n + 2)
        level[n], queue = 0, deque([n])
        while queue:
            u = queue.popleft()
            for e in arcs[u]:
                if room[e] and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if level[n + 1] < 0:
            return np.array(level[:n]) >= 0
        at, path, u = [0] * (n + 2), [], n
        while True:
            if u == n + 1:
                push = min(room[e] for e in path)
                for i, e in enumerate(path):
                    room[e] -= push
                    room[e ^ 1] += push
                first = next(i for i, e in enumerate(path) if not room[e])
                u, path = head[path[first] ^ 1], path[:first]
                continue
            while at[u] < len(arcs[u]):
                e = arcs[u][at[u]]
                if room[e] and level[head[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(arcs[u]):
                path.append(arcs[u][at[u]])
                u = head[path[-1]]
            elif path:
                level[u] = -1
                u = head[path.pop() ^ 1]
            else:
                break


def least(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, w: np.ndarray, wn: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Labels of the least sum, from s on: steps halve from the largest residual's size, and
    at each size moves are made while they lower the sum."""
    s = s.astype(np.int64).copy()
    r = s[b] - s[a] - d
    step = 1 << int(np.abs(r).max(initial=0)).bit_length()
    while step:
        now, up, down = cost(r, w, wn), cost(r + step, w, wn), cost(r - step, w, wn)
        # a move of b alone costs up, of a alone down, of both nothing: with x = 1 for moved,
        # (down - now) x_a + (now - down) x_b + (up + down - 2 now) (1 - x_a) x_b
        gain = np.bincount(a, down - now, n) + np.bincount(b, now - down, n)
        gain = np.rint(gain).astype(np.int64)
        side = minimum_cut(n, b, a, up + down - 2 * now, np.maximum(-gain, 0), np.maximum(gain, 0))
        moved = r + step * (side[b].astype(np.int64) - side[a])
        if cost(moved, w, wn).sum() < now.sum():
            s, r = s + step * side, moved
        else:
            step >>= 1
    return s


def _solve(x: pd.DataFrame) -> pd.DataFrame:
    """Labels of one block's own nodes.  Rows are votes with the labels of both ends and
    whether they may move; those that may not are one node, the ground, at label 0."""
    a, b, d, sa, sb = (x[k].to_numpy(np.int64) for k in ("a", "b", "d", "sa", "sb"))
    fa, fb = ~x["free_a"].to_numpy(bool), ~x["free_b"].to_numpy(bool)
    d = d + np.where(fa, sa, 0) - np.where(fb, sb, 0)
    names, at = np.unique(np.concatenate((a[~fa], b[~fb])), return_inverse=True)
    n = len(names)
    i, j = np.full(len(a), n), np.full(len(b), n)
    i[~fa], j[~fb] = at[: (~fa).sum()], at[(~fa).sum() :]
    s = np.zeros(n + 1, np.int64)
    s[i[~fa]], s[j[~fb]] = sa[~fa], sb[~fb]
    got = least(n + 1, i, j, d, x["w"].to_numpy(np.int64), x["wn"].to_numpy(np.int64), s)
    if fa.any() or fb.any():
        got = got - got[n]
    return pd.DataFrame({"node": names, "s": got[:n]})


def _solved(rows: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """labels with those of rows' blocks replaced by the least ones."""
    new = scratch.save(rows.groupBy("block").applyInPandas(lambda x: _solve(x), "node long, s long"))
    return scratch.save(labels.join(new.withColumnRenamed("s", "new"), "node", "left").select("node", F.coalesce("new", "s").alias("s")))


def _blocks(votes: DataFrame, nodes: DataFrame, seed: int, size: int, scratch: Scratch) -> DataFrame:
    """node, block: neighbourhoods of chosen nodes, up to three votes wide, cut at ``size``."""
    pick = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, size // 8))) == 0
    near = scratch.save(nodes.select("node", F.when(pick, c("node")).alias("lead")))
    ways = votes.select("a", "b").unionByName(votes.select(c("b").alias("a"), c("a").alias("b")))
    for _ in range(3):
        told = ways.join(near.where("lead is not null").select(c("node").alias("a"), "lead"), "a").groupBy(c("b").alias("node")).agg(F.min("lead").alias("told"))
        near = scratch.save(near.join(told, "node", "left").select("node", F.coalesce("lead", "told").alias("lead")), near)
    held = near.select("node", F.coalesce("lead", F.xxhash64(F.lit(seed), F.pmod(c("node"), F.lit(64)))).alias("lead"))
    many = held.groupBy("lead").agg(F.ceil(F.count("*") / size).alias("cuts"))
    return scratch.save(held.join(many, "lead").select("node", F.xxhash64("lead", F.pmod(F.xxhash64("node", F.lit(seed + 1)), c("cuts"))).alias("block")))


def _with_ends(votes: DataFrame, table: DataFrame) -> DataFrame:
    """votes with what table (node, ...) says of both ends."""
    more = [n for n in table.columns if n != "node"]
    for x in "ab":
        votes = votes.join(table.select(c("node").alias(x), *(c(n).alias(f"{n}_{x}") for n in more)), x)
    return votes


def _by_blocks(votes: DataFrame, labels: DataFrame, seed: int, size: int, scratch: Scratch) -> DataFrame:
    """One cut into blocks.  Blocks that are the first of all they share votes with move,
    while the others hold still, so that the sum can only fall; then whole blocks shift
    against each other, which is the same problem with a node a block."""
    block = _blocks(votes, labels, seed, size, scratch)
    held = scratch.save(_with_ends(votes, labels.join(block, "node")))
    apart = held.where("block_a <> block_b").select(F.explode(F.array(F.struct(c("block_a").alias("u"), c("block_b").alias("v")), F.struct(c("block_b").alias("u"), c("block_a").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
    rank = lambda x: F.struct(F.xxhash64(x, F.lit(seed)), c(x))
    later = apart.where(rank("u") > rank("v")).select(c("u").alias("block")).distinct()
    first = scratch.save(block.select("block").distinct().join(later, "block", "left_anti"))
    ends = F.explode(F.array_distinct(F.array("block_a", "block_b")))
    rows = held.withColumn("block", ends).join(first, "block")
    rows = rows.select("block", "a", "b", "d", "w", "wn", c("s_a").alias("sa"), c("s_b").alias("sb"), (c("block_a") == c("block")).alias("free_a"), (c("block_b") == c("block")).alias("free_b"))
    labels = _solved(rows, labels, scratch)
    # whole blocks: d is what a vote still asks for
    held = _with_ends(votes, labels.join(block, "node")).where("block_a <> block_b")
    coarse = merge_votes(held.select(c("block_a").alias("a"), c("block_b").alias("b"), (c("d") - c("s_b") + c("s_a")).alias("d"), "w", "wn"))
    shift = least_potentials(scratch.save(coarse), size=size, cuts=1, scratch=scratch)
    return scratch.save(labels.join(block, "node").join(shift.select(c("node").alias("block"), c("s").alias("shift")), "block", "left").select("node", (c("s") + F.coalesce("shift", F.lit(0))).alias("s")))


def least_potentials(votes: DataFrame, start: DataFrame | None = None, size: int = BLOCK, cuts: int = CUTS, scratch: Scratch | None = None) -> DataFrame:
    """node, s of merged votes, from start (node, s; 0 where it has none).

    A component of up to ``size`` nodes is solved at once: no labels have a smaller sum.
    A larger one is cut into blocks again and again; each cut lowers the sum, or leaves it,
    by moves within blocks and of whole blocks.  Labels are the start's up to one number a
    component, so that its smallest node keeps its label."""
    scratch = scratch or Scratch(votes.sparkSession)
    part = scratch.save(components(votes).select("node", c("component").alias("part")))
    if start is None:
        start = part.select("node", F.lit(0).cast("long").alias("s"))
    labels = scratch.save(part.select("node").join(start.select("node", c("s").cast("long").alias("s")), "node", "left").select("node", F.coalesce("s", F.lit(0)).alias("s")))
    first = labels
    many = scratch.save(part.groupBy("part").agg(F.count("*").alias("n")))
    sized = scratch.save(votes.join(part.withColumnRenamed("node", "a"), "a").join(many, "part"))
    whole = _with_ends(sized.where(c("n") <= size), labels)
    rows = whole.select(c("part").alias("block"), "a", "b", "d", "w", "wn", c("s_a").alias("sa"), c("s_b").alias("sb"), F.lit(True).alias("free_a"), F.lit(True).alias("free_b"))
    labels = _solved(rows, labels, scratch)
    large = sized.where(c("n") > size).select("a", "b", "d", "w", "wn")
    if not large.isEmpty():
        inside = part.join(many.where(c("n") > size), "part").select("node")
        mine = scratch.save(labels.join(inside, "node"))
        before, idle, seed = energy(large, mine).first()[0], 0, 0
        while idle < cuts and before:
            mine = _by_blocks(large, mine, seed, size, scratch)
            now = energy(large, mine).first()[0]
            idle = idle + 1 if (before - now) * FALL < before else 0
            before, seed = now, seed + 1
        labels = scratch.save(labels.join(inside, "node", "left_anti").unionByName(mine.select("node", "s")))
    base = part.where("node = part").join(first, "node").select("part", c("s").alias("was")).join(labels.select(c("node").alias("part"), c("s").alias("now")), "part")
    return labels.join(part, "node").join(base, "part").select("node", (c("s") - c("now") + c("was")).alias("s"))
