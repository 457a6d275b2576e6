"""Findings of the third round, one test or two each."""

import time

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from gridloom.operators import bench, fuse, graph, hashing, joins, surfaces
from gridloom.plans.catalogue import ORACLES, QUERIES


def against_sql(spark, folder, name, **tables):
    """Rows of a query on small tables, and of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.to_parquet(f"{folder}/{t}.parquet", index=False)
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, str(folder)).toPandas()
    want = con.execute(ORACLES[name]).df()[list(got.columns)]
    show = lambda df: sorted(tuple("" if v != v or v is None else f"{float(v):.6f}" for v in r) for r in df.itertuples(index=False))
    return show(got), show(want)


def test_f1_dominance_by_one_join(spark):
    import random

    rng = random.Random(4)
    rows = sorted({(s, rng.randrange(-9, 20), rng.randrange(9), rng.randrange(9)) for s in "abc" for _ in range(120)})
    q = {r: rng.randrange(1, 9) for r in rows}
    block = lambda r: (r[0], *(v // 8 for v in r[1:]))
    mean = {}
    for r in rows:
        mean.setdefault(block(r), []).append(q[r])
    score = {r: (sum(mean[block(r)]) / len(mean[block(r)]), -ord(r[0])) for r in rows}
    near = {r: [o for o in rows if o[0] != r[0] and all(abs(u - v) <= 2 for u, v in zip(o[1:], r[1:]))] for r in rows}
    want = {(*r, not near[r]) for r in rows if all(score[o] < score[r] for o in near[r])}
    got = surfaces.dominant(spark.createDataFrame([(*r, q[r]) for r in rows], "s string, z long, y long, x long, q int"), ["z", "y", "x"], "s", "q", 8, 2)
    assert {tuple(r) for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_f2_medoid_of_many_rows(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 4 == 0, 10).otherwise(F.col("id") % 252).cast("int").alias("c"), (1 + F.col("id") % 5).cast("int").alias("w"))
    start = time.monotonic()
    got = fuse.medoid(rows, ["k"], "c", "w").collect()
    assert [r["code"] for r in got] == [10] and time.monotonic() - start < 30


def test_f4_nearest_among_many(spark, monkeypatch):
    a = spark.range(3000).select("id", (F.col("id") % 60).cast("double").alias("u"), (F.floor(F.col("id") / 60) / 3.0).alias("v"))
    b = a.select(F.col("id").alias("n"), (F.col("u") + 0.1).alias("u"), "v").unionByName(spark.createDataFrame([(9999, 75.0, 0.0)], "n long, u double, v double"))
    met, plain = [], joins.radius_pairs
    monkeypatch.setattr(joins, "radius_pairs", lambda *x: met.append(plain(*x)) or met[-1])
    far = a.unionByName(spark.createDataFrame([(5000, 85.0, 0.0), (5001, 200.0, 0.0), (5002, None, 0.0)], "id long, u double, v double"))
    got = {r["id"]: r["n"] for r in joins.nearest(far, b, ["u", "v"], "id", "n", 15.0).collect()}
    assert got == {k: k for k in range(3000)} | {5000: 9999}
    assert sum(p.count() for p in met) < 200_000  # all pairs within the radius are millions


def test_f4_near_ties_as_in_sql(spark, tmp_path):
    # the second odd row is nearer by less than its larger number outweighs
    rows = [(2, 5, 0.0), (1, 7, 40.0), (900_001 - 900_001 % 211 + 1 + 211 * (1 - (900_001 // 211) % 2), 9, 40.0 - 4e-6), (3, 1, 300.0), (4, 2, 301.0), (600, 3, 9000.0)]
    got, want = against_sql(spark, tmp_path, "fiber_contacts", customer=pd.DataFrame(rows, columns=["c_custkey", "c_nationkey", "c_acctbal"]))
    assert got == want


def test_f5_each_row_its_distance(spark, tmp_path):
    customer = pd.DataFrame({"c_custkey": [1, 1, 2, 3, 4, 5], "c_acctbal": [10.0, 900.0, 460.0, 2000.0, None, -390.0]})
    supplier = pd.DataFrame({"s_suppkey": [1, 2, 3], "s_acctbal": [0.0, 50.0, None]})
    got, want = against_sql(spark, tmp_path, "wrapdist", customer=customer, supplier=supplier)
    assert got == want


def test_f6_links_of_one_place_in_order(spark):
    rows = [(1, 0, 5, 0, 1), (1, 0, 0, -5, 2)]
    df = spark.createDataFrame(rows, "line long, pos long, prior long, step long, row long")
    swapped = df.withColumn("row", -F.col("row"))
    runs = [[tuple(r) for r in graph.chain_gauges(d, ["line"], [0, 1, 2, 3, 4, 5], ["row"]).select("gauge", "cost").collect()] for d in (df, swapped)]
    assert [r[0][1] for r in runs] == [0.0, 5.0]


def test_f7_cells_beyond_21_bits(spark):
    cells = [(3_000_000, -5, 2_097_151), (902_848, -5, 2_097_151), (1 << 40, 0, -(1 << 33))]
    df = spark.createDataFrame(cells, "z long, y long, x long")
    axes = [F.col(k) for k in "zyx"]
    got = df.select(*hashing.unpack_cell(hashing.pack_cell(*axes), hashing.cell_page(*axes)))
    assert [tuple(r) for r in got.collect()] == cells


def test_f7_as_in_sql(spark, tmp_path):
    rows = [(9_000_000, 7, 3, 1.0), (9_000_000 - (1 << 21), 7, 3, 1.0), (5, 1_200_000, 1, 2.0), (5, 1_200_000, 1, 3.0)]
    got, want = against_sql(spark, tmp_path, "pack_cells", lineitem=pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"]))
    assert got == want


def test_f8_fusion_of_many_rows(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 21 + F.when((F.col("id") % 2 == 1) & (F.col("id") == 59_999), 100).otherwise(0)).cast("int").alias("c"))
    start = time.monotonic()
    got = {r["k"]: (r["n_known"], r["outcome"], r["code"]) for r in fuse.fuse_phase(rows, ["k"], "c", 30).collect()}
    assert got == {0: (30_000, "agree", 10), 1: (30_000, "conflict", None)} and time.monotonic() - start < 30


def test_f9_wide_gaps_and_equal_places(spark, tmp_path):
    rows = [(1, 0, 1), (1, 0, 3), (1, 0, 3), (1, 10**14, 1), (1, 10**14, 1), (1, 10**14, 3), (1, 10**14 + 5, 1), (1, 10**14 + 9, 3), (2, 4, 1), (2, 5, 3), (3, 7, 1), (3, 7, 1), (3, 8, 3), (4, 1, 3), (4, 2, 1), (4, 3, 1)]
    df = pd.DataFrame(rows, columns=["l_suppkey", "l_orderkey", "l_linenumber"]).assign(l_partkey=range(len(rows)))
    got, want = against_sql(spark, tmp_path, "wrap_check", lineitem=df)
    assert got == want and len(got) == 3


def test_f10_bootstrap_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(bench, "CHUNK", 4)
    monkeypatch.setattr(bench, "SHARES", 3)
    a = spark.createDataFrame([(k, k % 3 == 0, float(k * k % 17)) for k in range(50)], "box long, stratum boolean, m double")
    b = a.withColumn("m", F.col("m") + F.col("box") % 2)
    runs = [[tuple(r) for r in bench.bootstrap(a, b, "box", "stratum", "m", draws=20, seed=3, held=held).orderBy("draw").collect()] for held in (100, 0)]
    assert [tuple(round(v, 9) for v in r) for r in runs[0]] == [tuple(round(v, 9) for v in r) for r in runs[1]]
    assert all(r["mb"] is None for r in bench.bootstrap(a, None, "box", "stratum", "m", draws=5, held=0).collect())


def test_f3_chains_without_all_candidates(spark, monkeypatch):
    n = F.col("id")
    tangent = F.when(n % 3 == 0, 1.0).otherwise(-1.0)
    ends = spark.range(90).select(F.floor(n / 2).alias("run"), (n % 2).cast("int").alias("end"), F.lit("h").alias("family"), (n * n * 37 % 997 / F.lit(500.0)).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), tangent.alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"))
    links = graph.end_links(ends, 1.0, 0.9, 0.5)
    want, whole = {tuple(r) for r in graph.chain_links(links).collect()}, links.count()
    met, plain = [], graph.chain_links
    monkeypatch.setattr(graph, "chain_links", lambda x: met.append(x.count()) or plain(x))
    assert {tuple(r) for r in graph.chain_ends(ends, 1.0, 0.9, 0.5).collect()} == want
    assert len(want) > 20 and len(met) > 1 and sum(met) < whole / 2
