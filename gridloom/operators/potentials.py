"""Potentials on graphs whose edges fix differences: forests, gauges, unwrapping, floods.

An edge (a, b, s, k) wants x_b = s * x_a + k, with s = 1 or -1.  ``gauged_forest`` joins
nodes along a maximum spanning forest and carries these maps along, so that every node
knows x_node = s * x_root + g; what the other edges say against it is their residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.scratch import Scratch, numbered

c = F.col


def gauged_forest(edges: DataFrame, *order: Column, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, root, s, g) and the tree edges (a, b, s, k, order_0, ...) of the spanning
    forest that prefers edges with a greater ``order``; ties go to the smaller (a, b, s, k),
    and edges that are equal in all count as one.

    In a round every tree takes its best edge outwards.  The trees so chained find the end
    of their chain by pointer jumping, which adds up the maps on the way; edges within a
    tree go, of those between two trees the best one stays.  Each round at least halves the
    trees, and nothing but a flag reaches the driver."""
    scratch = scratch or Scratch(edges.sparkSession)
    start = edges.where("a <> b").select(c("a").cast("long").alias("a"), c("b").cast("long").alias("b"), c("s").cast("int").alias("s"), c("k").cast("long").alias("k"), *(o.alias(f"__o{i}") for i, o in enumerate(order)))
    key = F.struct(*(c(f"__o{i}").alias(f"o{i}") for i in range(len(order))), *((-c(n)).alias(n) for n in ("a", "b", "s", "k")))
    live = scratch.save(start.select(c("a").alias("ca"), c("b").alias("cb"), "s", "k", key.alias("key")).distinct())
    nodes = scratch.save(live.select(F.explode(F.array("ca", "cb")).alias("node")).distinct().select("node", c("node").alias("root"), F.lit(1).alias("s"), F.lit(0).cast("long").alias("g")))
    tree = live.select("key").limit(0)
    while not live.isEmpty():
        ends = F.explode(F.array(F.struct(c("cb").alias("c"), c("ca").alias("p"), "s", c("k").alias("g")), F.struct(c("ca").alias("c"), c("cb").alias("p"), "s", (-c("s") * c("k")).alias("g"))))
        best = live.select("key", ends.alias("e")).groupBy("e.c").agg(F.max(F.struct("key", "e.p", "e.s", "e.g")).alias("m"))
        best = scratch.save(best.select("c", "m.p", "m.s", "m.g", "m.key"))
        tree = tree.unionByName(best.select("key"))
        # two trees that took the same edge: the smaller one is the end of the chain
        back = best.select(c("c").alias("p"), c("p").alias("pp"))
        ends = (c("pp") == c("c")) & (c("c") < c("p"))
        none = {"p": c("c"), "s": F.lit(1), "g": F.lit(0).cast("long")}
        hop = scratch.save(best.join(back, "p").select("c", *(F.when(ends, v).otherwise(c(n)).alias(n) for n, v in none.items())))
        while True:
            far = hop
            for _ in range(2):
                on = far.select(c("c").alias("p"), c("p").alias("pp"), c("s").alias("sp"), c("g").alias("gp"))
                far = far.join(on, "p").select("c", c("pp").alias("p"), (c("s") * c("sp")).alias("s"), (c("s") * c("gp") + c("g")).alias("g"))
            far = scratch.save(far.join(hop.select("c", c("p").alias("was")), "c").withColumn("moved", c("p") != c("was")).drop("was"), hop)
            moved = not far.where("moved").isEmpty()
            hop = far.drop("moved")
            if not moved:
                break
        up = hop.select(c("c").alias("root"), c("p").alias("top"), c("s").alias("st"), c("g").alias("gt"))
        nodes = scratch.save(nodes.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), (c("s") * F.coalesce("st", F.lit(1))).alias("s"), (c("g") + c("s") * F.coalesce("gt", F.lit(0))).alias("g")), nodes)
        side = lambda x: hop.select(c("c").alias(f"c{x}"), c("p").alias(f"p{x}"), c("s").alias(f"s{x}"), c("g").alias(f"g{x}"))
        moved = live.join(side("a"), "ca").join(side("b"), "cb").where("pa <> pb")
        turn = c("sb") * c("s") * c("sa")
        moved = moved.select(c("pa").alias("ca"), c("pb").alias("cb"), turn.alias("s"), (c("sb") * (c("s") * c("ga") + c("k") - c("gb"))).alias("k"), "key")
        # of the edges between two trees the best one, whichever way round
        flip = c("ca") > c("cb")
        moved = moved.select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), "s", F.when(flip, -c("s") * c("k")).otherwise(c("k")).alias("k"), "key")
        moved = moved.groupBy("ca", "cb").agg(F.max(F.struct("key", "s", "k")).alias("m")).select("ca", "cb", "m.s", "m.k", "m.key")
        live = scratch.save(moved, live, hop)
    return nodes, tree.distinct().select(*((-c(f"key.{n}")).alias(n) for n in ("a", "b", "s", "k")), *(c(f"key.o{i}").alias(f"order_{i}") for i in range(len(order))))


def residuals(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with root, turned (the edge's s is not that of its ends) and residual: what
    its k exceeds the difference of its ends by, in units of node b."""
    end = lambda x: nodes.select(c("node").alias(x), c("root").alias("root") if x == "a" else c("root").alias("__root"), c("s").alias(f"__s{x}"), c("g").alias(f"__g{x}"))
    both = edges.join(end("a"), "a").join(end("b"), "b")
    want = c("__gb") - c("s") * c("__ga")
    out = both.withColumns({"turned": c("__sa") * c("__sb") != c("s"), "residual": F.when(c("__sa") * c("__sb") == c("s"), c("k") - want)})
    return out.drop("__root", "__sa", "__sb", "__ga", "__gb")


def stitch(edges: DataFrame, boxes: DataFrame, min_agree: float, min_weight: float, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """One gauge for fitted boxes.

    edges: a, b, s, k, agree, weight: W_b is about s * W_a + k, so agree and weight say.
    boxes: box, low, high (the range of W), and excluded.  Returns boxes (box, part, s, g):
    s * W + g is one field on each part, and starts in [1, 2); parts are numbered from the
    largest on, and signed like their box with the most edges.  And edges with used, tree
    and residual: 9999 where the signs along the tree deny that of the edge."""
    scratch = scratch or Scratch(edges.sparkSession)
    bad = boxes.where("excluded").select("box")
    good = (c("agree") >= min_agree) & (c("weight") >= min_weight)
    marked = edges.join(bad.select(c("box").alias("a"), F.lit(True).alias("xa")), "a", "left").join(bad.select(c("box").alias("b"), F.lit(True).alias("xb")), "b", "left")
    marked = scratch.save(marked.withColumn("used", good & c("xa").isNull() & c("xb").isNull()).drop("xa", "xb"))
    used = marked.where("used")
    nodes, tree = gauged_forest(used, c("agree"), c("weight"), scratch=scratch)
    degree = used.select(F.explode(F.array("a", "b")).alias("box")).groupBy("box").agg(F.count("*").alias("degree"))
    # x = s * (W - g) is the root's W
    each = boxes.join(nodes.withColumnRenamed("node", "box"), "box", "left").join(degree, "box", "left")
    each = scratch.save(each.select("box", "low", "high", F.coalesce("root", "box").alias("root"), F.coalesce("s", F.lit(1)).alias("s"), F.coalesce(-c("s") * c("g"), F.lit(0)).alias("g"), F.coalesce("degree", F.lit(0)).alias("degree")))
    part = each.groupBy("root").agg(F.count("*").alias("size"), F.max(F.struct("degree", (-c("box")).alias("box"), "s")).alias("m")).select("root", "size", "m.degree", (-c("m.box")).alias("lead"), c("m.s").alias("turn"))
    part = numbered(part, "part", F.desc("size"), F.desc("degree"), F.asc("lead"), scratch=scratch).select("root", "part", "turn")
    turned = scratch.save(each.join(part, "root").select("box", "root", "part", (c("s") * c("turn")).alias("s"), (c("g") * c("turn")).alias("g"), "low", "high"))
    least = turned.groupBy("root").agg(F.floor(F.min(F.when(c("s") > 0, c("low")).otherwise(-c("high")) + c("g"))).alias("least"))
    placed = turned.join(least, "root").select("box", "part", "s", (c("g") + 1 - c("least")).alias("g"))
    told = residuals(used, nodes).join(tree.withColumnsRenamed({"order_0": "agree", "order_1": "weight"}).withColumn("tree", F.lit(True)), ["a", "b", "s", "k", "agree", "weight"], "left")
    told = told.withColumn("residual", F.when(c("turned"), 9999).otherwise(c("residual"))).drop("root", "turned")
    rest = marked.where("not used").withColumns({"residual": F.lit(0).cast("long"), "tree": F.lit(False)})
    return placed, told.withColumn("tree", F.coalesce("tree", F.lit(False))).unionByName(rest)


# -- cells of a grid -----------------------------------------------------------------------

AXES = ("x", "y", "z")
#: Codes of one turn.
TURN = 252


def grid_joins(cells: DataFrame, kept: list[str]) -> DataFrame:
    """Pairs of cells side by side: a, b (numbers of the cells), axis (0 for x, 1 y, 2 z),
    and the kept columns of both, as name_a and name_b.  cells: cell, z, y, x and those."""
    left = cells.select(c("cell").alias("a"), *AXES, *(c(n).alias(f"{n}_a") for n in kept))
    right = cells.select(c("cell").alias("b"), *AXES, *(c(n).alias(f"{n}_b") for n in kept))
    out = None
    for i, axis in enumerate(AXES):
        ahead = right.withColumn(axis, c(axis) - 1)
        pairs = left.join(ahead, list(AXES)).select("a", "b", F.lit(i).alias("axis"), *AXES, *(f"{n}_{e}" for n in kept for e in "ab"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def turn_step(a: str, b: str) -> tuple[Column, Column]:
    """The step between two codes in (-126, 126], and the whole turns it crosses."""
    half = TURN // 2
    step = F.pmod(c(b) - c(a) + half - 1, F.lit(TURN)) - (half - 1)
    return step, F.round((c(a) + step - c(b)) / TURN).cast("long")


def _numbered_cells(cells: DataFrame, scratch: Scratch, *more: str) -> DataFrame:
    """Known cells, numbered in scan order (z, y, x)."""
    return scratch.save(numbered(cells.where(c("code").isNotNull()).select("z", "y", "x", "code", *more), "cell", "z", "y", "x", scratch=scratch))


def unwrap_parts(cells: DataFrame, step: int, fewest: int, most: int = 15, spare: int = 8, share: int = 500, scratch: Scratch | None = None) -> DataFrame:
    """Relative turns of cyclic codes: z, y, x, part, code4 of the cells of parts that keep.

    cells: z, y, x, code (0..251, null: unknown).  Neighbours whose codes are at most
    ``step`` apart are joined; a part is what joins hold together, and its turns are known
    up to one number, which is 0 for its first cell.  Joins count in scan order, x before y
    before z: one that closes a loop whose turns do not add up is a conflict.  Parts with
    fewer cells than ``fewest`` and those with more than ``spare`` conflicts plus one in
    ``share`` joins go; of the others the ``most`` largest stay, numbered by size, then by
    first cell.  code4 is the turn mod 4 in 63 codes a turn."""
    scratch = scratch or Scratch(cells.sparkSession)
    known = _numbered_cells(cells, scratch)
    apart, turns = turn_step("code_a", "code_b")
    # a join is met when its later cell is scanned
    joins = grid_joins(known, ["code"]).where(F.abs(apart) <= step).select("a", "b", "axis", F.lit(1).alias("s"), turns.alias("k"))
    joins = scratch.save(joins)
    nodes, _ = gauged_forest(joins, -c("b"), -c("axis"), scratch=scratch)
    against = residuals(joins, nodes).groupBy("root").agg(F.count("*").alias("joins"), F.count_if(c("residual") != 0).alias("conflicts"))
    each = scratch.save(known.join(nodes.select(c("node").alias("cell"), "root", "g"), "cell", "left").withColumn("root", F.coalesce("root", "cell")))
    parts = each.groupBy("root").agg(F.count("*").alias("size"), F.min(F.struct("cell", "g")).alias("first")).join(against, "root", "left").where(c("size") >= fewest)
    parts = parts.where(F.coalesce("conflicts", F.lit(0)) <= spare + F.floor(F.coalesce("joins", F.lit(0)) / share))
    top = scratch.save(parts.orderBy(F.desc("size"), "first.cell").limit(most))
    top = numbered(top, "part", F.desc("size"), F.asc("first.cell"), scratch=scratch).select("root", "part", c("first.g").alias("base"))
    turn = F.coalesce("g", F.lit(0)) - F.coalesce("base", F.lit(0))
    code4 = F.pmod(F.floor(c("code") / 4 + F.lit(0.5)) + turn * (TURN // 4), F.lit(TURN))
    return each.join(F.broadcast(top), "root").select("z", "y", "x", c("part").cast("int").alias("part"), code4.cast("int").alias("code4"))


def flood_turns(cells: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Whole turns of cyclic codes, spread from the surest cells: z, y, x, seed (number of
    the part's seed cell), turn.

    cells: z, y, x, code (null: unknown), sure.  A part's seed is its surest cell, the
    first of equals, and has turn 0 (or its ``start``, where cells have that column).  From
    the cells reached so far, the surest join to a new one is taken each time, a join being
    as sure as its less sure cell, then as the other, then first in scan order; the new cell
    takes the turn that keeps it within half a turn of the cell it is reached from.  That
    is Prim's order, whose tree is the maximum spanning one wherever it starts: trees are
    grown everywhere at once and joined, in rounds that grow with the logarithm of the
    parts' size and not with the cells on a path."""
    scratch = scratch or Scratch(cells.sparkSession)
    more = ["start"] if "start" in cells.columns else []
    known = _numbered_cells(cells, scratch, "sure", *more)
    _, turns = turn_step("code_a", "code_b")
    joins = scratch.save(grid_joins(known, ["code", "sure"]).select("a", "b", F.lit(1).alias("s"), turns.alias("k"), F.least("sure_a", "sure_b").alias("low"), F.greatest("sure_a", "sure_b").alias("high")))
    nodes, _ = gauged_forest(joins, c("low"), c("high"), scratch=scratch)
    each = scratch.save(known.join(nodes.select(c("node").alias("cell"), "root", "g"), "cell", "left").select("cell", "z", "y", "x", "sure", *more, F.coalesce("root", "cell").alias("root"), F.coalesce("g", F.lit(0)).alias("g")))
    start = F.coalesce("start", F.lit(0)) if more else F.lit(0)
    seeds = each.groupBy("root").agg(F.max(F.struct("sure", (-c("cell")).alias("cell"), (start - c("g")).alias("base"))).alias("m")).select("root", (-c("m.cell")).alias("seed"), "m.base")
    return each.join(seeds, "root").select("z", "y", "x", "seed", (c("g") + c("base")).alias("turn"))
