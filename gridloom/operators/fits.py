"""Least squares over tables: robust affine maps and potentials on lattices.

Every round is one or two jobs over saved tables; what reaches the driver is a handful of
sums of a fixed size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.scratch import Scratch

c = F.col
FROM, TO = ("x", "y", "z"), ("u", "v", "w")


def robust_affine(pairs: DataFrame, huber: float, rounds: int = 12, scratch: Scratch | None = None) -> tuple[np.ndarray, list[float]]:
    """The affine map of points (x, y, z) to (u, v, w): a 3 x 4 matrix, and the sum of
    weighted squared distances of each round.

    pairs also have ``weight``; those of 0 or less count nothing.  A pair whose distance
    exceeds ``huber`` counts by huber / distance in the next round; with huber 0 there is
    one round.  A round is one aggregate of the 10 + 12 + 1 sums of its normal equations."""
    scratch = scratch or Scratch(pairs.sparkSession)
    rows = scratch.save(pairs.where("weight > 0").select(*(c(n).cast("double").alias(n) for n in (*FROM, *TO, "weight"))))
    first = rows.agg(F.sum("weight").alias("n"), *((F.sum(c("weight") * c(a)) / F.sum("weight")).alias(a) for a in FROM)).first()
    if not first.n:
        raise ValueError("no pair has weight")
    mid = np.array([first[a] for a in FROM])
    p = [*(c(a) - float(m) for a, m in zip(FROM, mid, strict=True)), F.lit(1.0)]
    weight, found, told = c("weight"), None, []
    for _ in range(rounds if huber > 0 else 1):
        upper = [(i, j) for i in range(4) for j in range(i, 4)]
        sums = [F.sum(weight * p[i] * p[j]) for i, j in upper] + [F.sum(weight * p[i] * c(k)) for k in TO for i in range(4)]
        sums.append(F.sum(weight * sum((c(k) * c(k) for k in TO), F.lit(0.0))))
        got = np.array(rows.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first(), float)
        gram = np.zeros((4, 4))
        for (i, j), x in zip(upper, got[:10], strict=True):
            gram[i, j] = gram[j, i] = x
        right = got[10:22].reshape(3, 4)
        found = np.linalg.solve(gram, right.T).T
        told.append(float(got[22] - 2 * (found * right).sum() + ((found @ gram) * found).sum()))
        off = [c(k) - sum((float(found[i, j]) * p[j] for j in range(4)), F.lit(0.0)) for i, k in enumerate(TO)]
        far = F.sqrt(sum((o * o for o in off), F.lit(0.0)))
        weight = c("weight") * F.when(far > huber, huber / far).otherwise(1.0)
    scratch.drop(rows)
    return np.column_stack((found[:, :3], found[:, 3] - found[:, :3] @ mid)), told


def affine_of(m: np.ndarray) -> list:
    """Columns u, v, w of points x, y, z under a 3 x 4 matrix."""
    return [sum((float(m[i, j]) * c(a) for j, a in enumerate(FROM)), F.lit(float(m[i, 3]))).alias(k) for i, k in enumerate(TO)]


def lattice_solve(cells: DataFrame, steps: DataFrame, tolerance: float = 1e-8, rounds: int = 400, scratch: Scratch | None = None) -> tuple[DataFrame, list[float]]:
    """Values that differ along steps as these say, in least squares: cell, value; and the
    relative residual after each round, the last one at most ``tolerance`` or that of round
    ``rounds``.

    cells: cell, z, y, x, target, pull (the weight of the target, 0: none).  steps: a, b
    (cells), d (value of b less that of a), w.  The normal equations are solved by
    conjugate gradients.  Each gradient is smoothed on all scales: it is summed up over
    blocks of 1, 2, 4, ... cells a side and divided by what the equations of each block
    weigh, so that far cells hear of each other in one round.  A round is two joins of the
    cells and one sum a scale; two scalars reach the driver."""
    scratch = scratch or Scratch(cells.sparkSession)
    both = steps.select("a", "b", "d", "w").unionByName(steps.select(c("b").alias("a"), c("a").alias("b"), (-c("d")).alias("d"), "w"))
    both = scratch.save(both.where("a <> b and w > 0"))
    own = both.groupBy(c("a").alias("cell")).agg(F.sum("w").alias("wide"), F.sum(c("w") * c("d")).alias("asked"))
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    nodes = scratch.save(cells.join(own, "cell", "left").select("cell", "z", "y", "x", (c("pull") + zero("wide")).alias("diag"), (c("pull") * zero("target") - zero("asked")).alias("right"), "pull"))
    ends = nodes.agg(*(f(a) for a in "zyx" for f in (F.min, F.max))).first()
    if ends[0] is None:
        return cells.select("cell", F.lit(0.0).alias("value")), []
    sides = [2**k for k in range(1, max(1, int(np.ceil(np.log2(max(ends[i + 1] - ends[i] + 1 for i in (0, 2, 4)) + 1))) + 1))]
    at = lambda t, side: [F.floor(c(f"{t}{a}") / side).alias(f"{a}{side}") for a in "zyx"]
    places = [f"{a}{side}" for side in sides for a in "zyx"]
    nodes = scratch.save(nodes.select("*", *(x for side in sides for x in at("", side))), nodes)
    # what the equations of a block weigh: the steps that leave it, and its pulls
    on = lambda t: nodes.select(c("cell").alias(t), *(c(p).alias(f"{t}_{p}") for p in places))
    crossing = both.join(on("a"), "a").join(on("b"), "b")
    scales = []
    for side in sides:
        key = [f"{a}{side}" for a in "zyx"]
        out = crossing.where(" or ".join(f"a_{k} <> b_{k}" for k in key)).groupBy(*(c(f"a_{k}").alias(k) for k in key)).agg(F.sum("w").alias("out"))
        held = nodes.groupBy(*key).agg(F.sum("pull").alias("pulls"))
        scales.append((key, scratch.save(held.join(out, key, "left").select(*key, (c("pulls") + zero("out")).alias("weighs")))))

    def smoothed(state: DataFrame) -> DataFrame:
        """state with h, its r smoothed on all scales."""
        state = state.withColumn("h", F.when(c("diag") > 0, c("r") / c("diag")).otherwise(0.0))
        for key, block in scales:
            part = state.groupBy(*key).agg(F.sum("r").alias("rs")).join(block, key).select(*key, F.when(c("weighs") > 0, c("rs") / c("weighs")).otherwise(0.0).alias("more"))
            state = state.join(part, key).withColumn("h", c("h") + c("more")).drop("more")
        return state

    keep = ["cell", "diag", *places]
    state = scratch.save(smoothed(nodes.select(*keep, F.lit(0.0).alias("value"), c("right").alias("r"), F.lit(0.0).alias("p"))))
    norm, rh = state.agg(F.sum(c("r") * c("r")), F.sum(c("r") * c("h"))).first()
    told, beta = [], 0.0
    while norm and len(told) < rounds and (not told or told[-1] > tolerance):
        moving = scratch.save(state.select(*keep, "value", "r", (c("h") + beta * c("p")).alias("p")), state)
        near = both.join(moving.select(c("cell").alias("b"), "p"), "b").groupBy(c("a").alias("cell")).agg(F.sum(c("w") * c("p")).alias("near"))
        moving = scratch.save(moving.join(near, "cell", "left").withColumn("q", c("diag") * c("p") - zero("near")).drop("near"), moving)
        pq = moving.agg(F.sum(c("p") * c("q"))).first()[0]
        if not pq or pq <= 0:
            state = moving
            break
        step = rh / pq
        state = scratch.save(smoothed(moving.select(*keep, (c("value") + step * c("p")).alias("value"), (c("r") - step * c("q")).alias("r"), "p")), moving)
        now, rh_now = state.agg(F.sum(c("r") * c("r")), F.sum(c("r") * c("h"))).first()
        told.append(float(np.sqrt(now / norm)))
        beta, rh = rh_now / rh, rh_now
        if not rh:
            break
    return state.select("cell", "value"), told
