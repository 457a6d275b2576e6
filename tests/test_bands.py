"""Labels between sheets, features across cubes, lines and grids in pieces: against brute force."""

import math
import random

from pyspark.sql import functions as F

from gridloom.operators import band, grid, joins, lines


def nearest(p, seeds, reach2):
    best = min((sum((a - b) ** 2 for a, b in zip(p, s, strict=True)), s) for s in seeds) if seeds else (math.inf, None)
    return best if best[0] <= reach2 else (None, None)


def volume(seed, shape=(7, 13, 12), holes=0.1):
    rng = random.Random(seed)
    out = {}
    for z in range(-2, shape[0] - 2):
        for y in range(shape[1]):
            for x in range(shape[2]):
                if rng.random() < holes:
                    continue
                d = int(math.hypot(y - 6, x - 6))
                code = 1 + 18 * (d // 3 + (3 if rng.random() < 0.02 else 0)) if d % 3 == 0 and rng.random() < 0.7 else 0
                out[z, y, x] = 255 if rng.random() < 0.01 else code
    return out


def frame(spark, cells):
    return spark.createDataFrame([(*k, v) for k, v in cells.items()], "z long, y long, x long, code long")


def test_nearest_features_over_cubes(spark):
    rng = random.Random(2)
    cells = [(rng.randrange(-9, 30), rng.randrange(-9, 30), rng.randrange(100), rng.random() < 0.06, rng.random() < 0.02) for _ in range(700)]
    cells = list({c[:2]: c for c in cells}.values())
    df = spark.createDataFrame(cells, "y int, x int, tag int, f boolean, g boolean")
    for side, reach in ((8, 5), (4, 11)):  # cubes larger and smaller than the reach
        got = {(r["y"], r["x"]): r for r in grid.nearest_features(df, {"f": F.col("f"), "g": F.col("g")}, side, reach, ("y", "x"), ("tag",)).collect()}
        assert len(got) == len(cells)
        tags = {c[:2]: c[2] for c in cells}
        for name, k in (("f", 3), ("g", 4)):
            seeds = [c[:2] for c in cells if c[k]]
            for c in cells:
                d2, at = nearest(c[:2], seeds, reach * reach)
                r = got[c[:2]]
                assert (r[f"{name}_d2"], r[f"{name}_y"], r[f"{name}_x"], r[f"{name}_tag"]) == (d2, *(at or (None, None)), tags.get(at))
    assert grid.nearest_features(df.limit(0), {"f": F.col("f")}, 8, 5, ("y", "x")).count() == 0


def brute_band(cells, axis, radius, span, g):
    seeds, half = [k for k, v in cells.items() if 0 < v < 255], (g - 1) / 2
    far = lambda p: (g * p[1] + half - axis[p[0]][0]) ** 2 + (g * p[2] + half - axis[p[0]][1]) ** 2
    found = {}
    for p in cells:
        d2, s = nearest(p, seeds, (radius / g) ** 2)
        if s is not None and not any(cells.get((p[0] + i, p[1] + j, p[2] + k)) == 255 for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)):
            out = far(p) >= far(s)
            found[p] = ((cells[s] - 1 + (9 if out else -9)) % 252, int(out), d2)
    jumps = set()
    for p, (b, _, d2) in found.items():
        for q in ((p[0] + 1, *p[1:]), (p[0], p[1] + 1, p[2]), (*p[:2], p[2] + 1)):
            if q in found and d2 > 1 and found[q][2] > 1 and min((b - found[q][0]) % 252, (found[q][0] - b) % 252) >= 9:
                jumps |= {p, q}
    cut = {p for p in found if any(sum((a - b) ** 2 for a, b in zip(p, j, strict=True)) <= (span / g) ** 2 for j in jumps)}
    return {p: found[p][:2] if p in found and p not in cut else (255, 255) for p in cells}, jumps


def test_band(spark):
    jumped = 0
    for seed, side in ((1, 4), (2, 64)):
        cells = volume(seed)
        axis = {z: (12.5 + z / 4, 12 - z / 8) for z in range(-2, 5)}
        want, jumps = brute_band(cells, axis, 7, 3, 2)
        jumped += len(jumps)
        got = band.band(frame(spark, cells), spark.createDataFrame([(z, *v) for z, v in axis.items()], "z long, cy double, cx double"), 7, 3, 2, side)
        assert {(r["z"], r["y"], r["x"]): (r["band"], r["side"]) for r in got.collect()} == want
    assert jumped
    none = spark.createDataFrame([(0, 0, k, 0) for k in range(5)], "z long, y long, x long, code long")
    for rows in (none, none.limit(0)):
        got = band.band(rows, rows.select("z", F.lit(0.0).alias("cy"), F.lit(0.0).alias("cx")).distinct(), 7, 3)
        assert {(r["band"], r["side"]) for r in got.collect()} <= {(255, 255)} and got.count() == rows.count()


def test_phase_pair(spark):
    kinds = set()
    for seed, reach, side in ((3, 6, 4), (4, 4, 64)):
        cells = volume(seed)
        got = {(r["z"], r["y"], r["x"]): (r["phase"], r["spacing"]) for r in band.phase_pair(frame(spark, cells), reach, side).collect()}
        turn = {k: (v - 1) // 18 for k, v in cells.items() if 0 < v < 255}
        for p in cells:
            want = (255, 0)
            (de, e), (do, o) = (nearest(p, [k for k, t in turn.items() if t % 2 == n], reach * reach) for n in (0, 1))
            if p in turn:
                want = (0, 0)
            elif e and o and (turn[o] - turn[e]) % 14 in (1, 13):
                a, b = math.sqrt(de), math.sqrt(do)
                if sum((i - k) * (j - k) for i, j, k in zip(e, o, p, strict=True)) <= -0.5 * a * b:
                    share = (a if (turn[o] - turn[e]) % 14 == 1 else b) / (a + b)
                    want = (round(share * 252) % 252, max(1, round(a + b)))
            kinds.add(want == (255, 0) or want[0] > 0)
            assert got[p] == want, p
    assert kinds == {True, False}


def test_band_arithmetic(spark):
    df = spark.createDataFrame([(0, 0), (251, 0), (126, 0), (127, 0), (5, 250), (255, 3), (3, 255)], "a int, b int")
    got = df.select(band.band_diff(F.col("a"), F.col("b")).alias("d"), band.band_winding(F.col("a"), F.col("b")).alias("w")).collect()
    assert [r["d"] for r in got[:5]] == [0, -1, 126, -125, 7]
    assert [r["w"] for r in got] == [243, 242, 117, 118, 14, 255, 255]


def test_next_along_pieces(spark):
    rng = random.Random(5)
    rows = [(k, p, rng.random()) for k in range(3) for p in rng.sample(range(500), 60)]
    got = {(r["k"], r["p"]): r["n"] for r in lines.next_along(spark.createDataFrame(rows, "k int, p int, v double"), ["k"], ["p"], {"n": "v"}, 16).collect()}
    for k in range(3):
        line = sorted(r[1:] for r in rows if r[0] == k)
        assert [got[k, p] for p, _ in line] == [v for _, v in line[1:]] + [None]


def test_jacobian_in_blocks(spark):
    rng = random.Random(6)
    rows = [(s, r, c, rng.random(), rng.random(), rng.random()) for s in range(2) for r in range(11) for c in range(9) if rng.random() < 0.9]
    at = {r[:3]: r[3:] for r in rows}
    df = spark.createDataFrame(rows, "s int, row int, col int, x double, y double, z double")
    for span in (1, 2):
        got = grid.jacobian(df, "s", span, side=4).collect()
        assert len(got) == len(rows)
        for g in got:
            around = [at.get((g["s"], g["row"] + i, g["col"] + j)) for i, j in ((0, span), (0, -span), (span, 0), (-span, 0))]
            if None in around:
                assert g["s1"] is None
                continue
            u, v = ([(p - q) / (2 * span) for p, q in zip(around[k], around[k + 1], strict=True)] for k in (0, 2))
            cross = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
            assert math.isclose(g["area"], math.hypot(*cross), rel_tol=1e-7, abs_tol=1e-9)


def test_largest_rectangle_with_gaps(spark):
    rng = random.Random(7)
    grids = {k: {(r, c): rng.random() < share for r in range(6) for c in range(8) if rng.random() < 0.9} for k, share in ((1, 0.8), (2, 0.5), (3, 0.0))}
    df = spark.createDataFrame([(k, *p, g) for k, cells in grids.items() for p, g in cells.items()], "k int, row int, col int, good boolean")
    got = {r["k"]: (r["area"], -r["row"], -r["col"], r["rows"], r["cols"]) for r in grid.largest_rectangle(df, "k", "good").collect()}
    for k, cells in grids.items():
        fits = [(h * w, -r, -c, h, w) for r in range(6) for c in range(8) for h in range(1, 7 - r) for w in range(1, 9 - c) if all(cells.get((i, j)) for i in range(r, r + h) for j in range(c, c + w))]
        assert got[k] == max(fits, default=(0, 0, 0, 0, 0))


def test_closest_on_line(spark):
    rng = random.Random(8)
    points = [(i, rng.randrange(3), rng.choice([None, *(x / 2 for x in range(-60, 60))])) for i in range(300)]
    knots = [(i, rng.choice([0, 1, 4]), rng.choice([None, *range(-40, 40)])) for i in range(50)]
    p = spark.createDataFrame(points, "id int, k int, v double")
    q = spark.createDataFrame([(i, k, None if v is None else float(v)) for i, k, v in knots], "src int, k int, v double")
    for width in (3.0, 1000.0):
        got = {r["id"]: (r["apart"], r["src"]) for r in joins.closest_on_line(p, q, ["k"], "v", "src", width).collect()}
        want = {i: min(((abs(v - w), j) for j, m, w in knots if m == k and w is not None), default=None) for i, k, v in points if v is not None}
        assert got == {i: x for i, x in want.items() if x}
    assert joins.closest_on_line(p, q.limit(0), ["k"], "v", "src", 3.0).count() == 0
