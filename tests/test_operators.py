"""Operators against brute force on small inputs."""

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions import circular
from gridloom.operators import fuse, graph, grid, joins, rays, stats, windows
from gridloom.sources import boxscan
from gridloom.streaming import frontier


def test_code_diff_and_wrap(spark):
    pairs = [(a, b) for a in (0, 1, 125, 126, 127, 251) for b in (0, 3, 126, 251)]
    got = spark.createDataFrame(pairs, "a int, b int").select(circular.code_diff(F.col("a"), F.col("b")).alias("d"), "a", "b").collect()
    assert all(r["d"] == (r["a"] - r["b"] + 126) % 252 - 126 for r in got)
    assert spark.range(1).select(circular.wrap_turn(F.lit(0.75))).first()[0] == -0.25


def test_fuse_outcomes(spark):
    rows = [(1, 10), (1, 14), (2, 250), (2, 2), (3, 0), (3, 126), (4, None), (5, 77), (5, None)]
    got = {r["k"]: (r["outcome"], r["code"]) for r in fuse.fuse_phase(spark.createDataFrame(rows, "k int, c int"), ["k"], "c", 8).collect()}
    assert got == {1: ("agree", 12), 2: ("agree", 0), 3: ("conflict", None), 4: ("none", None), 5: ("single", 77)}


def test_fold_is_ordered(spark):
    rows = [(1, 2, 9), (1, 1, 5), (2, 1, 5), (2, 2, 20), (3, 1, None)]
    got = {r["k"]: (r["code"], r["conflict"]) for r in fuse.fold_codes(spark.createDataFrame(rows, "k int, o int, c int"), ["k"], "o", "c").collect()}
    assert got == {1: (5, False), 2: (None, True), 3: (None, False)}


def test_weighted_median_midpoint(spark):
    rows = [(1, 1, 1), (1, 3, 1), (2, 1, 1), (2, 2, 3)]
    got = {r["k"]: r["median"] for r in fuse.weighted_median(spark.createDataFrame(rows, "k int, v int, w int"), ["k"], "v", "w").collect()}
    assert got == {1: 2.0, 2: 2.0}


def test_joins_against_all_pairs(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(60)]
    b = [(i, rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(40)]
    d2 = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    x, y = spark.createDataFrame(a, "id int, u double, v double"), spark.createDataFrame(b, "id int, u double, v double")
    got = {(r["id_a"], r["id_b"]) for r in joins.radius_pairs(x, y, ["u", "v"], 4.0).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if d2(p, q) <= 16}
    near = {r["id"]: r["n"] for r in joins.nearest(x, y.withColumnRenamed("id", "n"), ["u", "v"], "id", "n", 6.0).collect()}
    assert near == {p[0]: min((d2(p, q), q[0]) for q in b)[1] for p in a if min(d2(p, q) for q in b) <= 36}
    plan = joins.radius_pairs(x, y, ["u", "v"], 4.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lerp_clamps(spark):
    knots = spark.createDataFrame([(10, 1.0), (20, 3.0)], "k int, v double")
    got = {r["z"]: r["v"] for r in joins.lerp_on(spark.createDataFrame([(0,), (10,), (15,), (20,), (99,)], "z int"), knots, "z", "k", ["v"], 10).collect()}
    assert got == {0: 1.0, 10: 1.0, 15: 2.0, 20: 3.0, 99: 3.0}


def test_many_knots_join_by_bucket(spark, monkeypatch):
    knots = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 2.0).alias("v"))
    points = spark.range(-5, 60).select(F.col("id").alias("z"))
    want = {r["z"]: r["v"] for r in joins.lerp_on(points, knots, "z", "k", ["v"], 8).collect()}
    monkeypatch.setattr(joins, "KNOTS", 10)
    assert {r["z"]: r["v"] for r in joins.lerp_on(points, knots, "z", "k", ["v"], 8).collect()} == want and len(want) == 65


def test_ranks_over_ranges(spark):
    rng = random.Random(12)
    v = [rng.randrange(50) for _ in range(400)]
    got = stats.average_ranks(spark.createDataFrame([(x,) for x in v], "v int"), "v").distinct().collect()
    assert {r["v"]: r["rank"] for r in got} == {x: sum(y < x for y in v) + (v.count(x) + 1) / 2 for x in v}


def test_switches(spark):
    rows = [(1, i, v) for i, v in enumerate([0.0, 0.2, 0.9, 1.1, 1.0, 0.1])]
    r = windows.switches(spark.createDataFrame(rows, "k int, o int, v double"), ["k"], "o", "v", 0.6).first()
    assert (r["n"], r["switches"]) == (6, 2.0)


def test_auc_forms_agree(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(0, 20), rng.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "p int, truth int")
    got = stats.auc_from_histogram(stats.class_histogram(df, "p", "truth"), "p").first()["auc"]
    pos, neg = [p for p, t in rows if t], [p for p, t in rows if not t]
    assert abs(got - sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / (len(pos) * len(neg))) < 1e-12


def test_components_and_forest(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 99)) for _ in range(30)] + [(100 + i, 101 + i, 1) for i in range(30)]
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), w) for a, b, w in edges if a != b}.values())
    root = {x: x for a, b, _ in edges for x in (a, b)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = 0
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            total += w
    df = spark.createDataFrame(edges, "a long, b long, w long")
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == {x: find(x) for x in root}
    forest = graph.spanning_forest(df).collect()
    assert len(forest) == len(root) - len({find(x) for x in root}) and sum(r["w"] for r in forest) == total


def test_chain_gauges_exact(spark):
    rng = random.Random(4)
    shifts = [-1, 0, 1, 2]
    rows = [(c, i, rng.choice(shifts), rng.choice([-1, 0, 1])) for c in range(3) for i in range(5)]
    got = {}
    for r in graph.chain_gauges(spark.createDataFrame(rows, "line long, pos long, prior long, step long"), ["line"], shifts).collect():
        got.setdefault(r["line"], []).append((r["pos"], r["gauge"], r["cost"]))
    for c in range(3):
        x = [r for r in rows if r[0] == c]
        cost = lambda s, x=x: sum(abs(a - r[2]) for a, r in zip(s, x)) + sum(abs(s[i] - s[i - 1] - x[i][3]) for i in range(1, 5))
        best = min((cost(s), s) for s in itertools.product(shifts, repeat=5))
        assert sorted(got[c])[0][2] == best[0] and cost([g for _, g, _ in sorted(got[c])]) == best[0]


def test_greedy_links(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(12), rng.randrange(12), rng.random()) for _ in range(60)]
    open_a, open_b, want = set(range(12)), set(range(12)), set()
    for a, b, c in sorted(rows, key=lambda r: r[2]):
        if a in open_a and b in open_b:
            open_a.remove(a)
            open_b.remove(b)
            want.add((a, b))
    assert {(r["a"], r["b"]) for r in graph.greedy_links(spark.createDataFrame(rows, "a int, b int, cost double")).collect()} == want


def test_peaks(spark):
    v = [0, 3, 1, 5, 2, 2, 4, 0]
    got = rays.peaks(spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k int, o int, v double"), "k", "o", "v", 1.5).collect()
    assert [(r["place"], r["prominence"]) for r in sorted(got, key=lambda r: r["place"])] == [(1, 2.0), (3, 5.0), (6, 2.0)]


def test_distance_transform_over_blocks(spark):
    rng = np.random.default_rng(6)
    f = rng.random((20, 20)) < 0.02
    rows = [(int(a), int(b), bool(f[a, b])) for a in range(20) for b in range(20)]
    got = {(r["a"], r["b"]): r["d2"] for r in grid.distance(spark.createDataFrame(rows, "a long, b long, f boolean"), "f", 8, 6, ("a", "b")).collect()}
    at = np.argwhere(f)
    for a, b, _ in rows:
        d = ((at - [a, b]) ** 2).sum(1).min() if len(at) else 1e9
        assert got[a, b] == (d if d <= 36 else None)


def test_tiles_cover(spark):
    t = grid.tiles((0, 0, 0), (10, 7, 5), 4, 1, spark).toPandas()
    seen = {(z, y, x) for r in t.itertuples() for z in range(r.z0, r.z1) for y in range(r.y0, r.y1) for x in range(r.x0, r.x1)}
    assert seen == set(itertools.product(range(10), range(7), range(5)))


def test_box_scan_prunes(spark, tmp_path):
    v = spark.range(4096).select(F.lit("a").alias("array"), F.lit(0).alias("level"), (F.col("id") % 512).alias("z"), F.floor(F.col("id") / 512).alias("y"), F.lit(0).cast("long").alias("x"), F.lit(1).alias("v"))
    boxscan.write_voxels(v, str(tmp_path / "v"))
    got = boxscan.box(spark.read.parquet(str(tmp_path / "v")), (100, 0, 0), (60, 4, 1), chunk=128)
    assert got.count() == 240
    assert "GreaterThanOrEqual(cz,0)" in got._jdf.queryExecution().toString()


def test_metric_reader_and_sinks(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("tag\tbox\tscroll\tids\tceil\na\tb1\ts\t0.5\tna\ntag\tbox\tscroll\tids\tceil\na\tb1\ts\t0.7\t0.9\n# note\n")
    r = boxscan.read_metrics(spark, str(tmp_path / "m.tsv")).collect()
    assert len(r) == 1 and abs(r[0]["ids"] - 0.6) < 1e-12 and r[0]["ceil"] == 0.9
    df = spark.range(5)
    one = boxscan.materialised(df, str(tmp_path), {"a": 1})
    assert one.count() == 5 and boxscan.materialised(spark.range(9), str(tmp_path), {"a": 1}).count() == 5
    assert boxscan.missing(spark.range(7), boxscan.derived_path(str(tmp_path), {"a": 1}), ["id"]).count() == 2


def test_log_fold(spark):
    log = [(1, 1, "add", 5), (1, 2, "add", 6), (1, 3, "undo", None), (2, 1, "add", 7), (2, 2, "del", None), (3, 1, "undo", None), (4, 1, "add", 1), (4, 2, "del", None), (4, 3, "undo", None)]
    got = {r["id"]: r["item"] for r in frontier.fold_log(spark.createDataFrame(log, "id int, seq int, op string, item int")).collect()}
    assert got == {1: 5, 4: 1}


def test_ready_chunks_stream(spark, tmp_path):
    src = tmp_path / "in"
    for k, part in enumerate([[(0, 3)], [(3, 4), (5, 8)], [(4, 5)]]):
        spark.createDataFrame(part, "z0 long, z1 long").coalesce(1).write.mode("append").parquet(str(src))
        q = frontier.ready_chunks(spark.readStream.schema("z0 long, z1 long").parquet(str(src)), 4).writeStream.outputMode("update").foreachBatch(lambda df, i, k=k: df.toPandas().to_csv(tmp_path / f"out{k}-{i}.csv", index=False)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    out = pd.concat([pd.read_csv(p) for p in sorted(tmp_path.glob("out*.csv"))])
    assert sorted(out["chunk"].tolist()) == [0, 1]


def test_raw_store_round_trip(spark, tmp_path):
    from gridloom.sources import rawstore

    rng = random.Random(13)
    cells = {(rng.randrange(20), rng.randrange(9), rng.randrange(7)): rng.randrange(1, 255) for _ in range(90)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "z long, y long, x long, v long")
    rawstore.write_raw(df, str(tmp_path / "a"), (20, 9, 7), (8, 4, 4))
    spark.dataSource.register(rawstore.RawStore)
    read = lambda **o: {tuple(r)[:3]: r["v"] for r in spark.read.format("rawstore").options(**o).load(str(tmp_path / "a")).collect()}
    assert read() == cells
    assert read(low="3,2,1", size="9,4,5") == {k: v for k, v in cells.items() if 3 <= k[0] < 12 and 2 <= k[1] < 6 and 1 <= k[2] < 6}
    assert len(rawstore.RawReader({"path": str(tmp_path / "a"), "low": "0,0,0", "size": "8,4,4"}).partitions()) <= 1


def test_drop_small_and_rectangle(spark):
    cells = [(0, 0), (0, 1), (1, 1), (5, 5), (8, 8), (8, 9)]
    assert {tuple(r) for r in grid.drop_small(spark.createDataFrame(cells, "a int, b int"), 3, ("a", "b")).collect()} == {(0, 0), (0, 1), (1, 1)}
    rng = random.Random(14)
    g = [[rng.random() < 0.7 for _ in range(7)] for _ in range(6)]
    best = max((h * w, -r, -c) for r in range(6) for c in range(7) for h in range(1, 7 - r) for w in range(1, 8 - c) if all(g[i][j] for i in range(r, r + h) for j in range(c, c + w)))
    got = grid.largest_rectangle(spark.createDataFrame([(1, r, c, g[r][c]) for r in range(6) for c in range(7)], "k int, row int, col int, good boolean"), "k", "good").first()
    assert got["area"] == best[0] and all(g[i][j] for i in range(got["row"], got["row"] + got["rows"]) for j in range(got["col"], got["col"] + got["cols"]))
