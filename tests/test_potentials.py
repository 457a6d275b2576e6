"""Forests with gauges, unwrapping, floods and least-cost potentials against serial ones."""

import heapq
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import l1, potentials


def kruskal(edges):
    """(node: (root, s, g)) and the tree, edges best first."""
    at, tree = {}, []
    for a, b, s, k in edges:
        for n in (a, b):
            at.setdefault(n, (n, 1, 0))
        (ra, sa, ga), (rb, sb, gb) = at[a], at[b]
        if ra != rb:
            tree.append((a, b, s, k))
            turn, shift = sb * s * sa, sb * (s * ga + k - gb)
            at |= {n: (ra, sn * turn, sn * shift + gn) for n, (r, sn, gn) in at.items() if r == rb}
    return at, tree


def test_forest_and_maps(spark):
    rng = np.random.default_rng(0)
    draw = zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.choice([-1, 1], 90), rng.integers(-3, 4, 90), rng.integers(0, 4, 90), strict=True)
    edges = {tuple(map(int, e)) for e in draw if e[0] != e[1]} | {(100 + i, 101 + i, -1, i, 1) for i in range(20)}  # a long path too
    nodes, tree = potentials.gauged_forest(spark.createDataFrame(list(edges), "a long, b long, s int, k long, w int"), F.col("w"))
    at, want = kruskal([e[:4] for e in sorted(edges, key=lambda e: (-e[4], *e[:4]))])
    assert {(r.a, r.b, r.s, r.k) for r in tree.collect()} == set(want)
    got = {r.node: (r.root, r.s, r.g) for r in nodes.collect()}
    assert got.keys() == at.keys()
    for n, (root, s, g) in got.items():
        _, sr, gr = at[root]
        assert (at[n][0], s * sr, s * gr + g) == (at[root][0], *at[n][1:])


def test_stitch_numbers_signs_and_residuals(spark):
    """A chain of three with a flip, an edge against it, a sign against it, a lone box."""
    edges = [(1, 2, 1, 5, 0.9, 10.0), (2, 3, -1, 4, 0.8, 10.0), (1, 3, -1, 0, 0.7, 10.0), (1, 3, 1, 0, 0.6, 10.0), (1, 4, 1, 0, 0.1, 10.0)]
    boxes = [(1, 0.0, 2.5, False), (2, 5.0, 7.5, False), (3, -3.5, -1.0, False), (4, 7.25, 9.0, False), (5, 0.0, 1.0, True)]
    got, told = potentials.stitch(spark.createDataFrame(edges, "a long, b long, s int, k long, agree double, weight double"), spark.createDataFrame(boxes, "box long, low double, high double, excluded boolean"), 0.5, 1.0)
    at = {r.box: (r.part, r.s, r.g) for r in got.collect()}
    assert {k: v[0] for k, v in at.items()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2}
    # one field: W_2 = W_1 + 5, W_3 = 4 - W_2
    field = lambda box, w: at[box][1] * w + at[box][2]
    assert field(1, 1.0) == field(2, 6.0) == field(3, -2.0) and at[1][1] == at[2][1] == -at[3][1] == 1
    assert min(field(1, 0.0), field(2, 5.0), field(3, -1.0)) == 1.0 and field(4, 7.25) == 1.25
    seen = {(r.a, r.b, r.s, r.k): (r.used, r.tree, r.residual) for r in told.collect()}
    assert seen == {(1, 2, 1, 5): (True, True, 0), (2, 3, -1, 4): (True, True, 0), (1, 3, -1, 0): (True, False, 1), (1, 3, 1, 0): (True, False, 9999), (1, 4, 1, 0): (False, False, 0)}


# ---- cells


def cells(seed, shape=(4, 6, 7), unknown=0.15):
    rng = np.random.default_rng(seed)
    code = rng.integers(0, 252, shape)
    code[rng.random(shape) < unknown] = -1
    return code, rng.integers(0, 5, shape)


def table(spark, code, sure):
    rows = [(*map(int, at), None if code[at] < 0 else int(code[at]), int(sure[at])) for at in np.ndindex(code.shape)]
    return spark.createDataFrame(rows, "z long, y long, x long, code int, sure int")


def turn_between(a, b):
    step = (b - a + 125) % 252 - 125
    return step, round((a + step - b) / 252)


def before(at):
    for axis in (2, 1, 0):
        if at[axis]:
            yield tuple(v - (i == axis) for i, v in enumerate(at))


def serial_parts(code, step, fewest, most, spare, share):
    """Union-find in scan order."""
    label, held = {}, {}
    for at in np.ndindex(code.shape):
        if code[at] < 0:
            continue
        label[at], held[at] = (at, 0), [[at], 0, 0]
        for a in before(at):
            if code[a] < 0:
                continue
            d, k = turn_between(int(code[a]), int(code[at]))
            if abs(d) > step:
                continue
            (ra, ga), (rb, gb) = label[a], label[at]
            held[ra][1] += 1
            if ra == rb:
                held[ra][2] += gb - ga != k
            else:
                other = held.pop(rb)
                for n in other[0]:
                    label[n] = (ra, label[n][1] + ga + k - gb)
                held[ra] = [held[ra][0] + other[0], held[ra][1] + other[1], held[ra][2] + other[2]]
    good = sorted((-len(n), min(n), r) for r, (n, j, bad) in held.items() if len(n) >= fewest and bad <= spare + j // share)
    return {n: (p, (int(code[n] / 4 + 0.5) + 63 * (label[n][1] - label[first][1])) % 252) for p, (_, first, r) in enumerate(good[:most]) for n in held[r][0]}


@pytest.mark.parametrize(("seed", "step", "spare", "share"), [(1, 60, 0, 1000), (1, 60, 8, 500), (2, 126, 8, 500), (2, 126, 100, 1)])
def test_unwrapping_equals_union_find(spark, seed, step, spare, share):
    """Few conflicts that a part survives, many that drop it, and many that are let be."""
    code, sure = cells(seed)
    got = {(r.z, r.y, r.x): (r.part, r.code4) for r in potentials.unwrap_parts(table(spark, code, sure), step, 2, 15, spare, share).collect()}
    assert got == serial_parts(code, step, 2, 15, spare, share)


def test_a_conflicting_loop_goes(spark):
    """A ring whose codes gain a turn on the way round, beside a ramp that does not."""
    code = np.full((1, 4, 9), -1)
    ring = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    for i, at in enumerate(ring):
        code[0][at] = i * 252 // 8
    code[0, 0, 4:] = (200 + 30 * np.arange(5)) % 252
    got = {(r.z, r.y, r.x): (r.part, r.code4) for r in potentials.unwrap_parts(table(spark, code, code * 0), 40, 2, 15, spare=0).collect()}
    assert got == {(0, 0, 4 + i): (0, (int((200 + 30 * i) % 252 / 4 + 0.5) + 63 * ((200 + 30 * i) // 252)) % 252) for i in range(5)}


@pytest.mark.parametrize("seed", [1, 4])
def test_flood_equals_a_heap(spark, seed):
    code, sure = cells(seed, unknown=0.4)
    known = [at for at in np.ndindex(code.shape) if code[at] >= 0]
    turn, number = {}, {at: i for i, at in enumerate(known)}
    near = {at: [] for at in known}
    for at in known:
        for a in before(at):
            if a in near:
                near[at].append((a, a, at))
                near[a].append((at, a, at))
    for seed_cell in sorted(known, key=lambda v: (-sure[v], number[v])):
        if seed_cell in turn:
            continue
        turn[seed_cell], heap = 0, []
        fresh = [seed_cell]
        while fresh or heap:
            for v in fresh:
                for u, a, b in near[v]:
                    if u not in turn:
                        heapq.heappush(heap, (-min(sure[a], sure[b]), -max(sure[a], sure[b]), number[a], number[b], u, a, b))
            fresh = []
            if heap:
                *_, u, a, b = heapq.heappop(heap)
                if u not in turn:
                    k = turn_between(int(code[a]), int(code[b]))[1]
                    turn[u] = turn[a] + k if u == b else turn[b] - k
                    fresh = [u]
    got = {(r.z, r.y, r.x): r.turn for r in potentials.flood_turns(table(spark, code, sure)).collect()}
    assert got == turn and len(set(got.values())) > 1


def test_tables_without_cells(spark):
    empty = spark.createDataFrame([], "z long, y long, x long, code int, sure int")
    assert potentials.unwrap_parts(empty, 10, 1).count() == 0 and potentials.flood_turns(empty).count() == 0
    lone = spark.createDataFrame([(0, 0, 0, 8, 1), (5, 5, 5, None, 9)], "z long, y long, x long, code int, sure int")
    assert [tuple(r) for r in potentials.unwrap_parts(lone, 10, 1).collect()] == [(0, 0, 0, 0, 2)]
    assert [(r.z, r.turn) for r in potentials.flood_turns(lone).collect()] == [(0, 0)]


# ---- least cost


def total(a, b, d, w, wn, s):
    return int(l1.cost(s[b] - s[a] - d, w, wn).sum())


def test_least_sum_of_small_graphs():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, m = int(rng.integers(2, 5)), int(rng.integers(1, 9))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        a, b = a[a != b], b[a != b]
        d, w, wn = rng.integers(-2, 3, len(a)), rng.integers(1, 6, len(a)), rng.integers(0, 6, len(a))
        got = total(a, b, d, w, wn, l1.least(n, a, b, d, w, wn, rng.integers(-2, 3, n)))
        reach = range(-6, 7)
        assert got == min(total(a, b, d, w, wn, np.array((0, *x))) for x in itertools.product(reach, repeat=n - 1))


def test_potentials_of_components_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), int(d), int(w)) for a, b, d, w in zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.integers(-2, 3, 90), rng.integers(1, 9, 90), strict=True)]
    rows += [(1000 + i, 1001 + i, 2, 3) for i in range(4)] + [(2000, 2001 + i % 3, i, 1) for i in range(9)]
    votes = l1.merge_votes(spark.createDataFrame(rows, "a long, b long, d int, w int"))
    held = [tuple(r) for r in votes.select("a", "b", "d", "w", "wn").collect()]
    names = sorted({x for r in held for x in r[:2]})
    a, b, d, w, wn = (np.array(x) for x in zip(*held, strict=True))
    a, b = np.searchsorted(names, a), np.searchsorted(names, b)
    best = total(a, b, d, w, wn, l1.least(len(names), a, b, d, w, wn, np.zeros(len(names), int)))
    flat = total(a, b, d, w, wn, np.zeros(len(names), int))
    start = spark.createDataFrame([(n, n % 3) for n in names], "node long, s int")
    begun = total(a, b, d, w, wn, np.array(names) % 3)
    whole = {r.node: r.s for r in l1.least_potentials(votes).collect()}
    assert total(a, b, d, w, wn, np.array([whole[n] for n in names])) == best and whole[1000] == 0 and whole[1004] == 8
    cut = {r.node: r.s for r in l1.least_potentials(votes, start, size=25, cuts=1).collect()}
    assert best <= total(a, b, d, w, wn, np.array([cut[n] for n in names])) < begun and best < flat


def test_one_sided_votes_keep_their_side(spark):
    votes = l1.merge_votes(spark.createDataFrame([(2, 1, -3, 5, 1), (1, 2, 3, 2, 7)], "a long, b long, d long, w long, wn long"))
    assert [tuple(r) for r in votes.select("a", "b", "d", "w", "wn").collect()] == [(1, 2, 3, 3, 12)]
