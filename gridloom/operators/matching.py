"""One-to-one links between ends of pieces, settled cell by cell."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.graph import checkpoint
from gridloom.operators.joins import first_ring

AXES, TANGENT = ["x", "y", "z"], ["tx", "ty", "tz"]
SEEN, ROWS, PAIRS = 200, 10_000, 1_000_000


def link_costs(a: np.ndarray, b: np.ndarray, gap: float, cos_least: float, lateral: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows (x, y, z, tx, ty, tz) of a and b link, and their costs: graph.end_links in
    arrays, operation by operation, so that costs are alike to the last bit."""
    dot = lambda p, q: ((0.0 + p[:, 0] * q[:, 0]) + p[:, 1] * q[:, 1]) + p[:, 2] * q[:, 2]
    v, ta, tb = b[:, :3] - a[:, :3], a[:, 3:], b[:, 3:]
    g, face, pa, pb = np.sqrt(dot(v, v)), -dot(ta, tb), dot(v, ta), -dot(v, tb)
    lat = np.maximum(*(np.sqrt(np.maximum(0.0, g * g - p * p)) for p in (pa, pb)))
    ahead = (g < 2) | ((pa >= cos_least * g) & (pb >= cos_least * g))
    cost = g / gap + (1 - face) / (1 - cos_least) + lat / lateral
    return (g <= reach) & (face >= cos_least) & ahead & (lat <= lateral), cost


def site_pairs(at: np.ndarray, home: np.ndarray, size: np.ndarray, limits: tuple, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sites (sorted by x) that link for at most ``bound``, by rising cost."""
    reach = limits[3] * 1.000001
    many = np.searchsorted(at[:, 0], np.nextafter(at[:, 0] + reach, np.inf), "right") - np.arange(len(at))
    ends, found, low = np.cumsum(many), [], 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(low, high), many[low:high])
        j = i + np.arange(len(i)) - np.repeat(ends[low:high] - many[low:high] - (ends[low - 1] if low else 0), many[low:high])
        near = (home[i] | home[j]) & ((i != j) | (size[i] > 1)) & (np.abs(at[i, 1] - at[j, 1]) <= reach) & (np.abs(at[i, 2] - at[j, 2]) <= reach)
        i, j = i[near], j[near]
        good, cost = link_costs(at[i], at[j], *limits)
        good &= cost <= bound
        found.append((i[good], j[good], cost[good]))
        low = high
    i, j, cost = (np.concatenate(p) for p in zip(*found, strict=True))
    order = np.argsort(cost, kind="stable")
    return i[order], j[order], cost[order]


def settle(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], members: list[list[int]], home: np.ndarray) -> tuple[list[tuple], list[int]]:
    """Links between members of sites by rising cost, ties by the members' numbers, as far as
    this cell can tell: links (members of a, of b, cost), and the sites left in doubt.

    Sites of other cells are in doubt from the start; a site is in doubt from the cheapest link
    to a doubtful one on.  Links of a cost take the members of a site in order, so a site
    is known by how many are taken."""
    doubt, taken, size = [not h for h in home.tolist()], [0] * len(members), [len(m) for m in members]
    links: list[tuple] = []
    first, second, costs = (p.tolist() for p in pairs)
    k = 0
    while k < len(costs):
        cost, tied = costs[k], []
        while k < len(costs) and costs[k] == cost:
            a, b = first[k], second[k]
            if taken[a] < size[a] and taken[b] < size[b] and not (doubt[a] and doubt[b]):
                tied.append((a, b))
            k += 1
        if not tied:
            continue
        near: dict[int, list[int]] = {}
        for a, b in tied:
            near.setdefault(a, []).append(b)
            if a != b:
                near.setdefault(b, []).append(a)
        spread = [s for s in near if doubt[s]]
        while spread:
            for s in near[spread.pop()]:
                if not doubt[s]:
                    doubt[s] = True
                    spread.append(s)
        shared = []
        for a, b in tied:
            if doubt[a]:
                continue
            if len(near[a]) == len(near[b]) == 1 and a != b:
                n = min(size[a] - taken[a], size[b] - taken[b])
                links.append((members[a][taken[a] : taken[a] + n], members[b][taken[b] : taken[b] + n], cost))
                taken[a] += n
                taken[b] += n
            else:
                shared += [a, b]
        heads = [(members[s][taken[s]], s) for s in set(shared)]
        heapify(heads)
        while heads:
            u, s = heappop(heads)
            if taken[s] == size[s] or members[s][taken[s]] != u:
                continue
            ahead = [(members[t][taken[t] + (t == s)], t) for t in near[s] if taken[t] + (t == s) < size[t]]
            if not ahead:
                continue
            v, t = min(ahead)
            links.append(([u], [v], cost))
            taken[s] += 1
            taken[t] += 1
            for w in {s, t}:
                if taken[w] < size[w]:
                    heappush(heads, (members[w][taken[w]], w))
    return links, [m for s, own in enumerate(home.tolist()) if own and doubt[s] for m in members[s][taken[s] :]]


def match_in_cells(ends: DataFrame, gap: float, cos_least: float, lateral: float, reach: float, shift: int) -> DataFrame:
    """Links within the reach that cells can tell, and ends that they leave in doubt (rows
    that are open).  A cell is ten reaches wide and sees the ends within one reach around."""
    c, kinds, wide = F.col, dict(ends.dtypes), 10 * reach
    bound = np.inf if reach >= gap else reach / gap - 1e-6  # unit tangents are so but for rounding
    at = lambda a, d: F.floor((c(a) + d * reach * 1.000001) / wide + (0.125 + 0.25 * (shift % 4)))
    cells, inside = [f"__c{a}" for a in AXES], F.lit(True)
    dealt = ends
    for a, n in zip(AXES, cells, strict=True):
        dealt = dealt.withColumn(n, F.explode(F.sequence(at(a, -1), at(a, 1))))
        inside = inside & (c(n) == at(a, 0))
    bucket = F.pmod(F.xxhash64("family", *cells), F.lit(ends.count() // ROWS + 1))
    limits = (gap, cos_least, lateral, reach)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["run", "end"], kind="stable", ignore_index=True)
        places, home = df[[*AXES, *TANGENT]].to_numpy(np.float64), df["__home"].to_numpy(bool)
        links, doubt = [], []
        for rows in df.groupby(["family", *cells], sort=False).indices.values():
            if len(rows) < 2 or not home[rows].any():
                continue
            rows = rows[np.lexsort((rows, *places[rows].T[::-1]))]
            starts = np.flatnonzero(np.r_[True, (places[rows[1:]] != places[rows[:-1]]).any(1)])
            members, sites = [m.tolist() for m in np.split(rows, starts[1:])], rows[starts]
            pairs = site_pairs(places[sites], home[sites], np.diff(np.r_[starts, len(rows)]), limits, bound)
            got, left = settle(pairs, members, home[sites])
            links += got
            doubt += left
        a, b = (np.array([m for x in links for m in x[s]] + doubt, np.int64) for s in (0, 1))
        cost = np.array([x[2] for x in links for _ in x[0]] + [0.0] * len(doubt))
        of = lambda rows, s: df[["run", "end"]].iloc[rows].set_axis([f"run_{s}", f"end_{s}"], axis=1).reset_index(drop=True)
        return pd.concat([of(np.minimum(a, b), "a"), of(np.maximum(a, b), "b")], axis=1).assign(cost=cost, open=np.arange(len(a)) >= len(a) - len(doubt))

    schema = f"run_a {kinds['run']}, end_a {kinds['end']}, run_b {kinds['run']}, end_b {kinds['end']}, cost double, open boolean"
    return dealt.select("run", "end", "family", *AXES, *TANGENT, *cells, inside.alias("__home"), bucket.alias("__b")).groupBy("__b").applyInPandas(run, schema)


def match_ends(pieces: DataFrame, gap: float, cos_least: float, lateral: float) -> DataFrame:
    """graph.end_links taken by rising cost where every run has one end, so that no chain can
    close: rows run_a, end_a, run_b, end_b, cost.

    A link of gap g costs at least g of the whole gap.  So ends within a small reach are
    linked first, as far as they cost no more than any link further off; then the reach
    doubles, for the ends that are left open.  Within a reach, cells go through their links in order
    up to what hangs on other cells; the ends left in doubt are dealt into cells that are
    shifted by a quarter.  Of the four shifts one has the cheapest link inside a cell, so
    that all ends come to an answer.  Ends at one place share their links, however many."""
    c = F.col
    open_ends = checkpoint(pieces.select("run", "end", "family", *AXES, *TANGENT))
    reach, taken = first_ring(open_ends.select("family", *AXES, *TANGENT).distinct(), AXES, gap, SEEN), []
    while True:
        live, shift, new = open_ends, 0, []
        while True:
            got = checkpoint(match_in_cells(live, gap, cos_least, lateral, reach, shift))
            new.append(got.where("not open").drop("open"))
            doubt = got.where("open").select(c("run_a").alias("run"), c("end_a").alias("end"))
            if not doubt.limit(1).count():
                break
            live, shift = checkpoint(live.join(doubt, ["run", "end"], "left_semi")), shift + 1
        taken += new
        if reach >= gap:
            break
        for links in new:
            shut = links.select(F.inline(F.array(*(F.struct(c(f"run_{s}").alias("run"), c(f"end_{s}").alias("end")) for s in "ab"))))
            open_ends = open_ends.join(shut, ["run", "end"], "left_anti")
        open_ends, reach = checkpoint(open_ends), reach * 2
    whole = taken[0]
    for links in taken[1:]:
        whole = whole.unionByName(links)
    return whole
