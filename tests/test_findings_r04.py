"""Findings of the fourth round."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import graph, matching

ENDS = "run long, end int, family string, x double, y double, z double, tx double, ty double, tz double"


def in_order(links):
    """Links taken one by one by rising cost, where every run has one end."""
    shut, taken = set(), set()
    for r in sorted(links.collect(), key=lambda r: (r["cost"], r["run_a"], r["end_a"], r["run_b"], r["end_b"])):
        if not {r["run_a"], r["run_b"]} & shut:
            shut |= {r["run_a"], r["run_b"]}
            taken.add(tuple(r)[:5])
    return taken


def test_f1_copies_of_a_place_at_once(spark, monkeypatch):
    rows = [(k * 30 + p, p % 2, "hv"[p % 3 == 0], p * p * 7 % 41 / 10.0, p % 4 / 2.0, 0.0, 1.0 if p % 5 < 2 else -1.0, 0.0, 0.0) for k in range(25) for p in range(30)]
    ends = spark.createDataFrame(rows, ENDS)
    made, plain = [], graph.checkpoint
    for module in (graph, matching):
        monkeypatch.setattr(module, "checkpoint", lambda df: made.append(1) or plain(df))
    got = {tuple(r) for r in graph.chain_ends(ends, 1.0, 0.9, 0.5).collect()}
    assert got == in_order(graph.end_links(ends, 1.0, 0.9, 0.5)) and len(got) >= 200
    assert len(made) < 25  # a round a copy took two each


@pytest.mark.parametrize("seed", range(3))
def test_f1_cells_agree_with_all_in_order(spark, monkeypatch, seed):
    monkeypatch.setattr(matching, "SEEN", (4, 200, 30)[seed])
    monkeypatch.setattr(matching, "ROWS", (50, 10_000, 200)[seed])
    monkeypatch.setattr(matching, "PAIRS", (7, 1_000_000, 1)[seed])
    rng, directions = random.Random(seed), [(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 0.6, 0.8), (0.0, -0.6, -0.8)]
    place = lambda: tuple(rng.randrange(-60, 60) / (12, 9, 9)[seed] for _ in "xyz")
    places = [(place(), rng.choice(directions)) for _ in range(250)]
    chosen = [rng.choice(places) for _ in range(500)]
    ends = spark.createDataFrame([((k * 7919) % 10_007 + (1 << 60), rng.randrange(2), rng.choice("hv"), *p, *t) for k, (p, t) in enumerate(chosen)], ENDS)
    odd = spark.createDataFrame([(1, 0, "h", float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0), (2, 0, None, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (3, 0, "h", 0.0, 0.0, None, -1.0, 0.0, 0.0)], ENDS)
    got = [tuple(r) for r in graph.chain_ends(ends.unionByName(odd), 4.0, 0.8, 3.0).collect()]
    want = in_order(graph.end_links(ends, 4.0, 0.8, 3.0))
    assert len(got) == len(want) > 30 and set(got) == want


def test_f1_runs_named_by_text(spark):
    rows = [(f"r{k}", 0, "h", k / 10.0, 0.0, 0.0, 1.0 if k % 2 else -1.0, 0.0, 0.0) for k in range(9)]
    ends = spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in ENDS.split(", ")]))
    got = graph.chain_ends(ends, 1.0, 0.9, 0.5)
    assert {tuple(r) for r in got.collect()} == in_order(graph.end_links(ends, 1.0, 0.9, 0.5)) and got.count() == 4
    assert graph.chain_ends(ends.where(F.lit(False)), 1.0, 0.9, 0.5).count() == 0


def test_f2_wide_and_negative_keys_as_in_sql(spark, tmp_path):
    from test_findings import against_sql

    rows = [(1, 1, 250_000_000, 3), (1, 2, 5, 0), (1, 3, 7, 4), (2, 1, -7, -4), (2, 2, -5, -1), (2, 2, 100_000_001, 2), (2, 3, -100_000_000, 3), (3, 4, 9, -2), (3, 4, 9, 3)]
    lineitem = pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).astype({"l_linenumber": "int32"})
    got, want = against_sql(spark, tmp_path, "chain_gauges", lineitem=lineitem)
    assert got == want and len(got) == 9
