"""Rules of single operators against brute force on small fixtures."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import bench, graph, grid, hashing, joins, lines, rays, surfaces


def test_links_in_order_of_cost_without_cycles(spark):
    rng = random.Random(5)
    for _ in range(1):
        ends = [(r, e) for r in range(8) for e in (0, 1)]
        links = [(a, b, rng.randrange(1000) / 7 + k / 1e6) for k, (a, b) in enumerate(rng.sample([p for p in itertools.combinations(ends, 2) if p[0][0] != p[1][0]], 40))]
        root, mated, want = list(range(8)), set(), set()

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b, _ in sorted(links, key=lambda x: x[2]):
            if a in mated or b in mated or find(a[0]) == find(b[0]):
                continue
            root[find(a[0])] = find(b[0])
            mated |= {a, b}
            want.add((*a, *b))
        df = spark.createDataFrame([(*a, *b, c) for a, b, c in links], "run_a long, end_a int, run_b long, end_b int, cost double")
        assert {tuple(r)[:4] for r in graph.chain_links(df).collect()} == want


def test_a_circle_cut_twice_is_joined_once(spark):
    links = [(0, 0, 1, 1, 1.0), (0, 1, 1, 0, 2.0)]
    df = spark.createDataFrame(links, "run_a long, end_a int, run_b long, end_b int, cost double")
    assert [tuple(r) for r in graph.chain_links(df).collect()] == [links[0]]


def test_end_links_geometry(spark):
    row = lambda run, end, fam, x, y, tx: (run, end, fam, float(x), float(y), 0.0, float(tx), 0.0, 0.0)
    rows = [row(1, 1, "h", 0, 0, 1), row(2, 0, "h", 4, 0, -1), row(3, 0, "v", 4, 0, -1), row(4, 0, "h", 4, 3, -1), row(5, 0, "h", -4, 0, -1), row(6, 0, "h", 30, 0, -1)]
    df = spark.createDataFrame(rows, "run long, end int, family string, x double, y double, z double, tx double, ty double, tz double")
    got = {(r["run_a"], r["run_b"]): r["cost"] for r in graph.end_links(df, 8.0, 0.8, 1.0).collect()}
    assert got == {(1, 2): 0.5}


@pytest.mark.parametrize("seed", range(3))
def test_chain_gauges_exhaustive(spark, seed):
    rng = random.Random(seed)
    shifts, n = [-1, 0, 1, 2], 6
    prior, step = [rng.randrange(-1, 3) for _ in range(n)], [rng.randrange(-2, 3) for _ in range(n)]
    cost = lambda g: sum(abs(a - p) for a, p in zip(g, prior)) + sum(abs(b - a - s) for a, b, s in zip(g, g[1:], step[1:]))
    best = min(itertools.product(shifts, repeat=n), key=lambda g: (cost(g), g))
    df = spark.createDataFrame([(1, k, p, s) for k, (p, s) in enumerate(zip(prior, step))], "line long, pos long, prior long, step long")
    got = sorted((r["pos"], r["gauge"], r["cost"]) for r in graph.chain_gauges(df, ["line"], shifts).collect())
    assert [g for _, g, _ in got] == list(best) and got[0][2] == cost(best)


def brute_peaks(v, least, window):
    """Plateaus that fall on both sides, with prominence in a window, by definition."""
    out, n, i = [], len(v), 1
    while i < n - 1:
        j = i
        while j + 1 < n and v[j + 1] == v[i]:
            j += 1
        if v[i] > v[i - 1] and j + 1 < n and v[j + 1] < v[i]:
            left = right = v[i]
            for q in range(i - 1, max(-1, i - window - 1), -1):
                if v[q] > v[i]:
                    break
                left = min(left, v[q])
            for q in range(j + 1, min(n, j + window + 1)):
                if v[q] > v[i]:
                    break
                right = min(right, v[q])
            if v[i] - max(left, right) >= least:
                out.append(((i + j) / 2, v[i], v[i] - max(left, right)))
        i = j + 1
    return out


def found_peaks(spark, profiles, material=lambda k, i: True, sigma=0.0, least=2.0, window=5, apart=0.0):
    rows = [(k, i, None if x is None else float(x), material(k, i)) for k, v in enumerate(profiles) for i, x in enumerate(v)]
    got = rays.ruled_peaks(spark.createDataFrame(rows, "k long, i long, v double, m boolean"), "k", "i", "v", "m", sigma, least, window, apart)
    out = {k: [] for k in range(len(profiles))}
    for r in sorted(got.collect()):
        out[r.k].append(tuple(r)[1:])
    return out


def test_peaks_by_definition(spark):
    rng = random.Random(2)
    profiles = [[rng.randrange(6) for _ in range(rng.randrange(0, 40))] for _ in range(150)]
    for k, got in found_peaks(spark, profiles).items():
        want = brute_peaks([float(x) for x in profiles[k]], 2, 5)
        assert [(h, p) for _, h, p, _ in got] == [(h, p) for _, h, p in want]
        assert all(abs(a[0] - b[0]) < 1 for a, b in zip(got, want, strict=True))


def test_peaks_rules(spark):
    v = [0, 4, 0, 0, 9, 9, 0, 8, 0.0]
    at = lambda **more: [p[0] for p in found_peaks(spark, [v], least=1.0, window=20, **more)[0]]
    assert at() == [1.0, 4.5, 7.0]
    assert at(apart=3.0) == [1.0, 4.5]  # of two near ones the higher
    assert at(material=lambda k, i: i > 2) == [4.5, 7.0]
    assert found_peaks(spark, [v], least=1.0, window=20)[0][1][3] == 2.0  # width at half prominence
    # a higher or unknown sample ends a side; level neighbours: the earlier stays, one after another
    gaps = found_peaks(spark, [[0, 5, 3, 9, 0], [None, 5, 1], [0, 5, None, 7, 0], [0, 5, 0, 5, 0, 6, 0, 4, 0]], least=1.0, window=20, apart=2.5)
    assert gaps == {0: [(2.9, 9.0, 9.0, 1.0)], 1: [], 2: [], 3: [(1.0, 5.0, 5.0, 1.0), (5.0, 6.0, 6.0, 1.0)]}


def test_peaks_are_smoothed_first(spark):
    got = found_peaks(spark, [[0, 0, 0, 8, 0, 0, 0, None, 3, 4, 3]], sigma=1.0, least=1.0, window=20)[0]
    assert [round(p[0], 6) for p in got] == [3.0] and 0 < got[0][1] < 8


def test_prominences_by_definition():
    rng = random.Random(4)
    for _ in range(200):
        v = np.array([rng.randrange(7) for _ in range(rng.randrange(0, 30))], float)
        want = []
        for i in range(1, len(v) - 1):
            if v[i - 1] < v[i] >= v[i + 1]:
                higher = [k for k in range(len(v)) if v[k] > v[i]]
                left, right = max([k for k in higher if k < i], default=-1), min([k for k in higher if k > i], default=len(v))
                want.append((i, v[i] - max(v[left + 1 : i + 1].min(), v[i:right].min())))
        assert rays.prominences(v) == want


def test_nearest_however_far(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e4, -3.0), (3, 5.0, 5.0)], "id long, a double, b double")
    b = spark.createDataFrame([(7, 1.0, 0.0), (8, 0.0, 1.0), (9, 40.0, 0.0)], "near long, a double, b double")
    assert sorted(tuple(r) for r in joins.nearest(a, b, ["a", "b"], "id", "near").collect()) == [(1, 7, 1.0), (2, 9, 9960.0**2 + 9.0), (3, 7, 41.0)]
    assert joins.nearest(a, b.limit(0), ["a", "b"], "id", "near").count() == 0


def test_distance_without_features(spark):
    df = spark.createDataFrame([(1, 1, 1, False), (5, 1, 1, False)], "z long, y long, x long, f boolean")
    assert [tuple(r) for r in grid.exact_distance(df, "f").orderBy("z").select("z", "d2", "near_z").collect()] == [(1, None, None), (5, None, None)]
    one = df.withColumn("f", F.col("z") == 1)
    assert [tuple(r) for r in grid.exact_distance(one, "f").orderBy("z").select("d2", "near_z").collect()] == [(0.0, 1), (16.0, 1)]


def test_dominance_ties_and_reach(spark):
    rows = [("a", 0, 0, 0, 5), ("b", 0, 0, 1, 5), ("b", 0, 0, 9, 1), ("c", 0, 0, 11, 9), ("a", 40, 0, 0, 1)]
    df = spark.createDataFrame(rows, "s string, z long, y long, x long, ct int")
    got = {(r["s"], r["z"], r["x"], r["alone"]) for r in surfaces.dominant(df, ["z", "y", "x"], "s", "ct", 8, 2).collect()}
    assert got == {("a", 0, 0, False), ("c", 0, 11, False), ("a", 40, 0, True)}


def test_priority_cover_one_by_one(spark):
    rng = random.Random(8)
    cells = {i: {rng.randrange(60) for _ in range(rng.randrange(1, 12))} for i in range(12)}
    rank = {i: rng.randrange(5) for i in cells}
    taken, want = set(), set()
    for i in sorted(cells, key=lambda i: (-rank[i], i)):
        if len(cells[i] & taken) <= 0.5 * len(cells[i]):
            want.add(i)
            taken |= cells[i]
    df = spark.createDataFrame([(i, c, rank[i]) for i, x in cells.items() for c in x], "item long, cell long, p int")
    assert {r["item"] for r in surfaces.priority_cover(df, "item", ["cell"], "p", 0.5).collect()} == want


def test_merge_close(spark):
    rows = [(1, 0.0, 5.0), (1, 1.0, 6.0), (1, 2.5, 7.0), (1, 9.0, 1.0), (2, 0.0, 3.0), (2, 1.0, 3.0)]
    got = sorted(tuple(r) for r in lines.merge_close(spark.createDataFrame(rows, "k long, at double, h double"), "k", "at", "h", 2.0).collect())
    assert got == [(1, 2.5, 7.0), (1, 9.0, 1.0), (2, 0.0, 3.0)]


def sequence(seed, n):
    s, out, top = seed, [], 2**64 - 1
    for _ in range(n):
        s = (s + 0x9E3779B97F4A7C15) & top
        x = s
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & top
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & top
        out.append(x ^ (x >> 31))
    return out


def test_numbers_of_a_sequence():
    assert hashing.nth_random(1, np.arange(1, 40)).tolist() == sequence(1, 39)
    assert hashing.crc32c(b"123456789") == 0xE3069283 and hashing.crc32c(b"") == 0


def test_bootstrap_by_hand_and_both_paths(spark):
    boxes = [(f"b{k:02d}", "s" if k % 3 else "t", float(k * k % 17)) for k in range(20)]
    a = spark.createDataFrame([*boxes, ("x", "s", float("nan")), ("y", "s", None)], "box string, stratum string, m double")
    b = spark.createDataFrame([(k, s, v + (i % 2)) for i, (k, s, v) in enumerate(boxes)], "box string, stratum string, m double")
    order = {s: [r for r in boxes if r[1] == s] for s in ("t", "s")}  # b00 is of t
    numbers, want = iter(sequence(3, 20 * 50)), []
    other = {r[0]: r[2] for r in b.toPandas().itertuples(index=False)} if False else {k: v + (i % 2) for i, (k, _, v) in enumerate(boxes)}
    for _ in range(50):
        pick = [rows[next(numbers) % len(rows)] for rows in order.values() for _ in rows]
        want.append((sum(r[2] for r in pick) / 20, sum(other[r[0]] for r in pick) / 20))
    for held in (100, 0):
        got = [(r["ma"], r["mb"]) for r in bench.bootstrap(a, b, "box", "stratum", "m", draws=50, seed=3, held=held).orderBy("draw").collect()]
        assert np.allclose(got, want)
    assert bench.bootstrap(a.limit(0), None, "box", "stratum", "m").count() == 0
    assert {r["box"] for r in bench.clean_set(spark.createDataFrame(pd.DataFrame({"box": ["p", "q", "r"], "ceil": [0.9, 0.5, float("nan")]})), "ceil", 0.8).collect()} == {"p", "r"}


def test_quantiles_of_few_ranges(spark):
    from gridloom.operators import quantiles

    rng = np.random.default_rng(3)
    x = pd.DataFrame({"k": rng.integers(0, 3, 400), "v": rng.integers(0, 40, 400).astype(float)})
    x = pd.concat((x, pd.DataFrame({"k": [7, 8, 8], "v": [5.0, 1.0, 2.0]})))
    got = quantiles.quantiles(spark.createDataFrame(x), ["k"], "v", {"a": 0.1, "m": 0.5, "z": 1.0}, ranges=5).toPandas().set_index("k")
    for k, g in x.groupby("k"):
        assert np.allclose(got.loc[k, ["a", "m", "z"]].astype(float), np.quantile(g["v"], [0.1, 0.5, 1.0]))


def test_covariance_and_projection(spark):
    from gridloom.operators import stats

    x = np.random.default_rng(4).normal(size=(50, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,), ([None, 1.0, 2.0],)], "v array<double>").repartition(4)
    assert np.allclose(stats.covariance(df, "v"), np.cov(x.T, bias=True))
    got = stats.project(df.limit(1), "v", [1.0, 0.0, 0.0], [[1.0, 0.0, 0.0], [0.0, 2.0, 0.0]]).first()
    assert got["v"] is None or np.allclose(got["projected"], [got["v"][0] - 1, 2 * got["v"][1]])
