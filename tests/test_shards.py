"""Sharded arrays: layouts, ranges, checksums, boxes, and the checksum itself."""

import json
import zlib

import numpy as np
import pytest

from gridloom.operators.hashing import crc32c
from gridloom.sources import shards


def by_bit(data: bytes) -> int:
    x = 0xFFFFFFFF
    for b in data:
        x ^= b
        for _ in range(8):
            x = (x >> 1) ^ (0x82F63B78 if x & 1 else 0)
    return x ^ 0xFFFFFFFF


def test_checksum_by_bits():
    rng = np.random.default_rng(0)
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0
    for n in (1, 63, 4095, 4096, 4097, 10_007):
        data = rng.integers(0, 256, n, np.uint8).tobytes()
        assert crc32c(data) == by_bit(data)


@pytest.fixture(scope="module")
def array(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    v = np.where(rng.random((20, 18, 30)) < 0.3, rng.integers(1, 900, (20, 18, 30)), 0)
    v[:8, :8, :16] = 0  # a whole file, and chunks elsewhere
    v[8:12, 8:12, 16:20] = 0
    root = str(tmp_path_factory.mktemp("shards") / "array")
    cells = spark.createDataFrame([(*map(int, at), int(v[at])) for at in np.ndindex(v.shape)], "z long, y long, x long, v long")
    shards.write_shards(cells, root, v.shape, (8, 8, 16), (4, 4, 4), "uint16", 0, ("zstd", "crc32c"))
    return v, root


def rows(df):
    return {(r.z, r.y, r.x): r.v for r in df.collect()}


def inside(v, low=(0, 0, 0), high=(99, 99, 99)):
    return {tuple(map(int, at)): int(v[tuple(at)]) for at in np.argwhere(v) if all(a <= i < b for a, i, b in zip(low, at, high, strict=True))}


def test_round_trip_and_boxes(spark, array):
    v, root = array
    assert rows(shards.read_shards(spark, root)) == inside(v)
    assert rows(shards.read_shards(spark, root, (3, 5, 7), (9, 4, 20))) == inside(v, (3, 5, 7), (12, 9, 27))
    assert rows(shards.read_shards(spark, root, (30, 0, 0), (5, 5, 5))) == {}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = shards.read_shards(spark, root).where("z >= 3 and z < 12 and y > 4 and y <= 8 and x = 17")
        assert rows(got) == inside(v, (3, 5, 17), (12, 9, 18))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_needed_bytes_are_read(array):
    v, root = array
    store, top = shards.pafs.FileSystem.from_uri(root)
    lay = shards.layout(store, top)
    with store.open_input_file(f"{top}/c/1/1/1") as f:
        raw = f.read()
    asked = []

    def read(at, n):
        asked.append((at, n))
        return raw[at : at + n]

    got = list(shards.chunks_of(read, len(raw), lay, (1, 1, 1), (8, 8, 20), (12, 12, 24)))
    assert len(got) == 1 and (got[0][0] == [8, 8, 20]).all() and (got[0][1] == v[8:12, 8:12, 20:24]).all()
    assert asked[0] == (len(raw) - lay.index_bytes, lay.index_bytes) and len(asked) == 2 and asked[1][1] < len(raw) / 8
    asked.clear()
    assert list(shards.chunks_of(read, len(raw), lay, (1, 1, 1), (8, 8, 16), (12, 12, 20))) == [] and len(asked) == 1  # fill only
    asked.clear()
    assert len(list(shards.chunks_of(read, len(raw), lay, (1, 1, 1), (0, 0, 0), v.shape))) == 15 and len(asked) == 2  # neighbours in one request


def test_files_outside_a_box_are_not_planned(array):
    _, root = array
    reader = shards.ShardReader({"path": root, "low": "0,8,16", "size": "9,8,14"})
    assert sorted(p.place for p in reader.partitions()) == [(0, 1, 1), (1, 1, 1)]


def test_broken_checksums_are_told(array):
    _, root = array
    store, top = shards.pafs.FileSystem.from_uri(root)
    lay = shards.layout(store, top)
    with store.open_input_file(f"{top}/c/1/1/1") as f:
        raw = f.read()
    for at, said in ((len(raw) - 9, "index"), (3, "chunk")):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(Exception, match=said if said == "index" else ".*"):
            list(shards.chunks_of(lambda a, n: bytes(bad[a : a + n]), len(raw), lay, (1, 1, 1), (0, 0, 0), (99, 99, 99)))  # noqa: B023


def test_chunk_files_of_the_older_layout(spark, tmp_path):
    v = np.arange(5 * 4 * 6).reshape(5, 4, 6) % 7
    root = tmp_path / "old"
    root.mkdir()
    (root / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [5, 4, 6], "chunks": [3, 4, 3], "dtype": "|u1", "fill_value": 0, "order": "C", "filters": None, "compressor": {"id": "zlib", "level": 1}}))
    whole = np.zeros((6, 4, 6), np.uint8)
    whole[:5] = v
    for i, k in np.ndindex(2, 2):
        if (i, k) != (1, 0):
            (root / f"{i}.0.{k}").write_bytes(zlib.compress(whole[3 * i : 3 * i + 3, :, 3 * k : 3 * k + 3].tobytes()))
    known = v.copy()
    known[3:, :, :3] = 0
    assert rows(shards.read_shards(spark, str(root))) == inside(known)
    # a chunk that comes late is seen by the next read
    (root / "1.0.0").write_bytes(zlib.compress(whole[3:, :, :3].tobytes()))
    assert rows(shards.read_shards(spark, str(root))) == inside(v)
    (root / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [5, 4, 6], "chunks": [3, 4, 3], "dtype": "|u1", "fill_value": 0, "order": "C", "filters": None, "compressor": {"id": "blosc"}}))
    with pytest.raises(Exception, match="blosc"):
        shards.read_shards(spark, str(root)).count()
