"""Resumable cover plans, and box scans of stored lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import lineboxes
from gridloom.streaming.cover import Cover, PlanChanged, digest


def plan(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "no long, key string")


def inputs(spark, keys):
    return spark.createDataFrame([(k, i) for k in keys for i in range(len(k))], "key string, v long")


def work(rows):
    return rows.groupBy("key").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def told(df):
    return sorted(tuple(r) for r in df.select("key", "total", "n").collect())


KEYS = ["a", "bb", "ccc", "dd", "e", "ffff", "gg"]


def test_stopped_and_resumed_equals_one_run(spark, tmp_path):
    whole, parts = Cover(spark, str(tmp_path / "one")), str(tmp_path / "two")
    assert whole.turn(plan(spark, KEYS), inputs(spark, KEYS), work, 100) and not whole.turn(plan(spark, KEYS), inputs(spark, KEYS), work, 100)

    def breaks(rows):
        raise RuntimeError("lost")

    assert Cover(spark, parts).turn(plan(spark, KEYS[:5]), inputs(spark, KEYS), work, 3)
    with pytest.raises(RuntimeError):
        Cover(spark, parts).turn(plan(spark, KEYS[:5]), inputs(spark, KEYS), breaks, 3)
    # data of a turn that was never committed is not read
    work(inputs(spark, ["zz"])).write.parquet(f"{parts}/rows/1-0")
    assert Cover(spark, parts).turn(plan(spark, KEYS[:5]), inputs(spark, KEYS), work, 1)
    while Cover(spark, parts).turn(plan(spark, KEYS), inputs(spark, KEYS), work, 2):  # extended
        pass
    again = Cover(spark, parts)
    assert told(again.result()) == told(whole.result()) and len(again.committed()) == 4 and again.open_keys() is None


def test_late_inputs_are_seen_later(spark, tmp_path):
    cover = Cover(spark, str(tmp_path / "late"))
    assert cover.result() is None
    assert cover.turn(plan(spark, KEYS), inputs(spark, ["a", "ccc"]), work, 4)
    assert [r.key for r in cover.open_keys().orderBy("no").collect()] == ["bb", "dd"] and told(cover.result()) == [("a", 0, 1), ("ccc", 3, 3)]
    assert cover.turn(plan(spark, KEYS), inputs(spark, KEYS[:-1]), work, 4) and [r.key for r in cover.open_keys().collect()] == ["gg"]
    assert cover.turn(plan(spark, KEYS), inputs(spark, KEYS), work, 4) and not cover.turn(plan(spark, KEYS), inputs(spark, KEYS), work, 4)
    assert told(cover.result()) == told(work(inputs(spark, KEYS)))


def test_a_changed_prefix_is_refused(spark, tmp_path):
    cover = Cover(spark, str(tmp_path / "changed"))
    cover.turn(plan(spark, KEYS), inputs(spark, KEYS), work, 3)
    for changed in (["a", "ccc", "bb", "dd"], ["a", "bb"]):
        with pytest.raises(PlanChanged):
            cover.turn(plan(spark, changed), inputs(spark, KEYS), work, 3)
    assert digest(plan(spark, KEYS), 3) == digest(plan(spark, KEYS[:3]), 9) != digest(plan(spark, ["bb", "a", "ccc"]), 3)


def test_line_scans_open_few_blocks(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for line in range(40):
        at = rng.uniform(0, 1000, 3)
        for seq in range(200):
            at = at + rng.normal(size=3)
            rows.append((line, seq, *map(float, at), f"n{line}"))
    lines = spark.createDataFrame(rows, "line long, seq long, x double, y double, z double, name string")
    path = str(tmp_path / "lines")
    lineboxes.write_lines(lines, path, points=20, blocks=10)
    total = spark.read.parquet(f"{path}/blocks").count()
    assert total == 400 and spark.read.parquet(f"{path}/points").count() == 8000 and spark.read.parquet(f"{path}/blocks").select("tile").distinct().count() >= 20
    seen = 0
    for k in (0, 7, 21):
        mid = np.array(rows[k * 200 + 100][2:5])
        low, high = tuple(map(float, mid - 8)), tuple(map(float, mid + 9))
        got = lineboxes.scan(spark, path, low, high)
        want = [r for r in rows if all(a <= v < b for a, v, b in zip(low, r[2:5], high, strict=True))]
        assert sorted(tuple(r[n] for n in ("line", "seq", "x", "y", "z", "name")) for r in got.collect()) == sorted(want) and want
        assert lineboxes.blocks_in(spark, path, low, high).count() < total / 10
        seen += got.count()
    assert lineboxes.scan(spark, path, (5000.0,) * 3, (6000.0,) * 3).count() == 0
    broken = lines.where("line = 3 and (seq < 20 or seq between 40 and 59 or seq >= 199)")
    assert sorted(tuple(r) for r in lineboxes.runs(broken).collect()) == [(3, 0, 0, 19, 20), (3, 1, 40, 59, 20), (3, 2, 199, 199, 1)]
