"""Sampling, box functions, fits and block bootstrap against numpy."""

import numpy as np
import pytest

from gridloom.operators import blocks, fits, sampling


def volume(spark, v):
    return spark.createDataFrame([(*map(int, at), float(v[at])) for at in np.ndindex(v.shape) if not np.isnan(v[at])], "z long, y long, x long, v double")


def eight(v, p):
    low = np.floor(p).astype(int)
    if (low < 0).any() or (low + 1 >= v.shape).any():
        return None
    got = sum(np.prod(np.where(k, p - low, 1 - p + low)) * v[tuple(low + k)] for k in map(np.array, np.ndindex(2, 2, 2)))
    return None if np.isnan(got) else got


@pytest.mark.parametrize(("level", "points"), [(1, 1 << 18), (4, 7)])
def test_trilinear(spark, monkeypatch, level, points):
    """Across chunk faces, over the edge, beside a missing cell; hot chunks in several tasks."""
    monkeypatch.setattr(sampling, "POINTS", points)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(11, 9, 10))
    v[3, 3, 3] = np.nan
    at = np.concatenate((rng.uniform(-1, 11, (150, 3)), rng.integers(0, 9, (40, 3)).astype(float), [[2.5, 2.5, 2.5]]))
    rows = [(i, *(float((x + 0.5) * level - 0.5) for x in p)) for i, p in enumerate(at)]
    rows += [(1000, None, 1.0, 1.0), (1001, float("nan"), 1.0, 1.0)]
    got = {r.id: r.value for r in sampling.trilinear(volume(spark, v), spark.createDataFrame(rows, "id long, z double, y double, x double"), level, chunk=4).collect()}
    assert len(got) == len(rows) and got[1000] is None and got[1001] is None
    for i, *p in rows[:-2]:
        want = eight(v, (np.array(p) + 0.5) / level - 0.5)
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-9)


def test_box_functions_know_their_surroundings(spark):
    def around(grid, origin):
        n = grid.shape[0] - 2
        total = sum(grid[i : i + n, j : j + n, k : k + n] for i in range(3) for j in range(3) for k in range(3))
        for at in np.argwhere(total != 0):
            yield (*(int(a + o) for a, o in zip(at, origin, strict=True)), float(total[tuple(at)]))

    rng = np.random.default_rng(1)
    v = np.where(rng.random((9, 8, 7)) < 0.2, rng.integers(1, 9, (9, 8, 7)), 0).astype(float)
    wide = np.pad(v, 2)
    want = {tuple(int(i) - 1 for i in at): 0.0 for at in np.ndindex(11, 10, 9)}
    for at in want:
        want[at] = float(wide[tuple(slice(i + 1, i + 4) for i in at)].sum())
    want = {k: s for k, s in want.items() if s}
    cells = volume(spark, np.where(v, v, np.nan))
    got = sampling.over_boxes(cells, around, "z long, y long, x long, s double", halo=1, chunk=4)
    assert {(r.z, r.y, r.x): r.s for r in got.collect()} == want
    call = sampling.register_box_function(spark, "test_around", around, "z bigint, y bigint, x bigint, s double", halo=1, chunk=4)
    sampling.with_boxes(cells, 1, 4).createOrReplaceTempView("boxed")
    assert {(r.z, r.y, r.x): r.s for r in spark.sql(f"select * from {call} where s > 0").collect()} == want


def test_robust_affine_equals_numpy(spark):
    rng = np.random.default_rng(0)
    true = np.array([[1, 0.1, 0, 5], [0, 0.9, 0.2, -3], [0.05, 0, 1.1, 7]])
    p = rng.normal(size=(200, 3)) * 50
    q = p @ true[:, :3].T + true[:, 3] + rng.normal(size=(200, 3)) * 0.1
    q[:30] += rng.normal(size=(30, 3)) * 80
    w = rng.integers(0, 3, 200).astype(float)
    df = spark.createDataFrame([(*map(float, a), *map(float, b), float(x)) for a, b, x in zip(p, q, w, strict=True)], "x double, y double, z double, u double, v double, w double, weight double")
    for huber in (0.0, 1.0):
        mid = (w[:, None] * p).sum(0) / w.sum()
        a, now = np.column_stack((p - mid, np.ones(200))), w
        for _ in range(12 if huber else 1):
            x = np.linalg.solve((a * now[:, None]).T @ a, (a * now[:, None]).T @ q).T
            far = np.sqrt(((q - a @ x.T) ** 2).sum(1))
            now = w * np.where(far > huber, huber / far, 1) if huber else w
        got, told = fits.robust_affine(df, huber)
        assert np.abs(got - np.column_stack((x[:, :3], x[:, 3] - x[:, :3] @ mid))).max() < 1e-9 and len(told) == (12 if huber else 1)
    assert np.abs(got - true).max() < 0.2
    with pytest.raises(ValueError, match="weight"):
        fits.robust_affine(df.where("weight < 0"), 1.0)


def test_lattice_equals_numpy(spark):
    rng = np.random.default_rng(2)
    shape = (3, 4, 3)
    number = {at: i for i, at in enumerate(np.ndindex(shape))}
    steps = [(number[at], number[to], float(rng.normal()), float(rng.random() + 0.1)) for at in number for k in range(3) if (to := tuple(v + (i == k) for i, v in enumerate(at))) in number]
    cells = [(i, *map(int, at), float(rng.normal()), 0.05 * (i % 2)) for at, i in number.items()]
    a, b = np.diag([c[5] for c in cells]), np.array([c[4] * c[5] for c in cells])
    for i, j, d, w in steps:
        a[i, i] += w
        a[j, j] += w
        a[i, j] -= w
        a[j, i] -= w
        b[i] -= w * d
        b[j] += w * d
    value, told = fits.lattice_solve(spark.createDataFrame(cells, "cell long, z long, y long, x long, target double, pull double"), spark.createDataFrame(steps, "a long, b long, d double, w double"), 1e-7)
    got = np.array([r.value for r in value.orderBy("cell").collect()])
    assert told[-1] <= 1e-7 and len(told) <= 36 and np.abs(a @ got - b).max() <= 1e-6 * np.abs(b).max() and np.abs(got - np.linalg.solve(a, b)).max() < 1e-5


def test_block_bootstrap_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(blocks, "DRAWS", 40)
    monkeypatch.setattr(blocks, "BLOCKS", 5)
    rng = np.random.default_rng(3)
    rows = [(int(b) * 7, m, int(np.clip(rng.normal(90 + 30 * y + 20 * (m == "a"), 40), 0, 255)), int(y)) for b in range(12) for y in rng.integers(0, 2, 15) for m in "ab"]
    got = {r.model: r for r in blocks.block_bootstrap(spark.createDataFrame(rows, "block long, model string, value int, truth int"), "b", draws=100).collect()}

    def random(seed, n):
        state, out = seed, []
        for _ in range(n):
            state = (state + 0x9E3779B97F4A7C15) % 2**64
            z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) % 2**64
            out.append(((z ^ (z >> 31)) * n) >> 64)
        return out

    def auc(sample, model):
        pos, neg = ([v for b in sample for k, m, v, y in rows if k == b * 7 and m == model and y == t] for t in (1, 0))
        return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])

    base = {m: auc(range(12), m) for m in "ab"}
    deltas = []
    for d in range(100):
        pick = random(0x5EED0000 + d, 12)
        deltas.append(auc(pick, "a") - auc(pick, "b"))
    assert got["a"].n == 180 and abs(got["a"].auc - base["a"]) < 1e-12 and abs(got["a"].delta - base["a"] + base["b"]) < 1e-12
    assert np.allclose([got["a"].low, got["a"].high], np.percentile(deltas, [2.5, 97.5])) and got["b"].delta is None
