"""Sharded arrays in the public Zarr layouts, read by byte ranges.

``spark.read.format("shards").load(root)`` gives (z, y, x, v) of the cells of a
three-dimensional array that are not its fill value.  Version 3 arrays may be sharded: a
file holds many chunks one after another and, at its end, an index of their places with a
CRC-32C; chunks of fill values only are absent.  Version 2 arrays have a file a chunk.

Conditions on z, y and x (with the option ``pushdown``, which ``read_shards`` sets where
spark.sql.python.filterPushdown.enabled is true), or the options
``low`` and ``size`` ("z,y,x"), become a half-open box.  A partition is a file that meets
the box; its task reads the index by its known length from the end, then the ranges of the
chunks inside, those close together in one request, and nothing else.  Files are reached
through the file system that the root's scheme names (local, hdfs, s3, gs), from the
executors; a file that is not there is fill, and is looked for again at the next read.
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridloom.operators.hashing import crc32c

SCHEMA = "z bigint, y bigint, x bigint, v bigint"
NONE = (1 << 64) - 1
#: Bytes between two wanted ranges that are rather read than asked around.
GAP = 1 << 16
AXES = ("z", "y", "x")


@dataclass(frozen=True)
class Layout:
    shape: tuple[int, ...]
    file: tuple[int, ...]
    chunk: tuple[int, ...]
    dtype: str
    fill: int
    codecs: tuple[str, ...]
    sharded: bool
    checked: bool
    names: str  # how a file is named by its place

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(f // c for f, c in zip(self.file, self.chunk, strict=True))

    @property
    def index_bytes(self) -> int:
        return 16 * int(np.prod(self.grid)) + (4 if self.checked else 0)


def _codecs(listed: list[dict]) -> tuple[str, ...]:
    names = [c["name"] for c in listed]
    if names[0] != "bytes" or set(names[1:]) - {"gzip", "zstd", "zlib", "crc32c"}:
        raise ValueError(f"codecs {names} are not read")
    return tuple(names[1:])


def layout(store: pafs.FileSystem, root: str) -> Layout:
    def document(name: str) -> dict | None:
        if store.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
            return None
        with store.open_input_file(f"{root}/{name}") as f:
            return json.loads(f.read())

    new = document("zarr.json")
    if new:
        file, fill = tuple(new["chunk_grid"]["configuration"]["chunk_shape"]), int(new["fill_value"])
        key = new.get("chunk_key_encoding", {"name": "default"})
        sep = key.get("configuration", {}).get("separator", "/")
        names = ("c" + sep if key["name"] == "default" else "") + sep.join(("{0}", "{1}", "{2}"))
        first = new["codecs"][0]
        if first["name"] == "sharding_indexed":
            inner = first["configuration"]
            if inner.get("index_location", "end") != "end":
                raise ValueError("only indexes at the end of a file are read")
            checked = any(c["name"] == "crc32c" for c in inner["index_codecs"])
            return Layout(tuple(new["shape"]), file, tuple(inner["chunk_shape"]), new["data_type"], fill, _codecs(inner["codecs"]), True, checked, names)
        return Layout(tuple(new["shape"]), file, file, new["data_type"], fill, _codecs(new["codecs"]), False, False, names)
    old = document(".zarray")
    if old is None:
        raise FileNotFoundError(f"{root} holds no array")
    packed = (old["compressor"] or {}).get("id")
    if packed not in (None, "zlib", "gzip", "zstd") or old.get("order", "C") != "C" or old.get("filters"):
        raise ValueError(f"compressor {packed} is not read")
    chunk = tuple(old["chunks"])
    return Layout(tuple(old["shape"]), chunk, chunk, old["dtype"], int(old["fill_value"] or 0), (packed,) if packed else (), False, False, old.get("dimension_separator", ".").join(("{0}", "{1}", "{2}")))


def _unpacked(raw: bytes, codecs: tuple[str, ...], size: int) -> bytes:
    for name in reversed(codecs):
        if name == "crc32c":
            raw, told = raw[:-4], int.from_bytes(raw[-4:], "little")
            if crc32c(raw) != told:
                raise ValueError("a chunk's checksum does not hold")
        else:
            raw = zlib.decompress(raw) if name == "zlib" else gzip.decompress(raw) if name == "gzip" else pa.decompress(raw, size, "zstd", asbytes=True)
    return raw


def _packed(raw: bytes, codecs: tuple[str, ...]) -> bytes:
    for name in codecs:
        if name == "crc32c":
            raw += crc32c(raw).to_bytes(4, "little")
        else:
            raw = zlib.compress(raw, 1) if name == "zlib" else gzip.compress(raw, 1, mtime=0) if name == "gzip" else pa.compress(raw, "zstd", asbytes=True)
    return raw


def chunks_of(read: Callable[[int, int], bytes], length: int, lay: Layout, place: tuple[int, ...], low: tuple[int, ...], high: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first cell, values) of the chunks of one file that meet the box; ``read`` gives
    bytes from an offset on."""
    base = np.array(place) * lay.file
    size = int(np.prod(lay.chunk)) * np.dtype(lay.dtype).itemsize
    shaped = lambda raw: np.frombuffer(_unpacked(raw, lay.codecs, size), lay.dtype).reshape(lay.chunk)
    if not lay.sharded:
        yield base, shaped(read(0, length))
        return
    raw = read(length - lay.index_bytes, lay.index_bytes)
    if lay.checked and crc32c(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
        raise ValueError("an index's checksum does not hold")
    index = np.frombuffer(raw, "<u8", 2 * int(np.prod(lay.grid))).reshape(*lay.grid, 2)
    spans = [range(max(0, (a - b) // c), min(g, -(-(h - b) // c))) for a, h, b, c, g in zip(low, high, base, lay.chunk, lay.grid, strict=True)]
    wanted = sorted((int(index[at][0]), int(index[at][1]), at) for at in product(*spans) if int(index[at][0]) != NONE)
    while wanted:
        n, end = 1, wanted[0][0] + wanted[0][1]
        while n < len(wanted) and wanted[n][0] <= end + GAP:
            end, n = max(end, wanted[n][0] + wanted[n][1]), n + 1
        start = wanted[0][0]
        part = read(start, end - start)
        for offset, many, at in wanted[:n]:
            yield base + np.array(at) * lay.chunk, shaped(part[offset - start : offset - start + many])
        wanted = wanted[n:]


class ShardFile(InputPartition):
    def __init__(self, place: tuple[int, ...]) -> None:
        self.place = place


class ShardReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        store, root = pafs.FileSystem.from_uri(self.uri)
        self.lay = layout(store, root)
        numbers = lambda k, d: tuple(int(i) for i in options[k].split(",")) if k in options else d
        self.low = list(numbers("low", (0, 0, 0)))
        self.high = [min(a + n, s) for a, n, s in zip(self.low, numbers("size", self.lay.shape), self.lay.shape, strict=True)]

    def partitions(self) -> list[ShardFile]:
        spans = [range(max(0, a) // c, -(-max(a, b) // c)) for a, b, c in zip(self.low, self.high, self.lay.file, strict=True)]
        return [ShardFile(p) for p in product(*spans)]

    def read(self, partition: ShardFile) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(self.uri)
        path = f"{root}/{self.lay.names.format(*partition.place)}"
        if store.get_file_info(path).type != pafs.FileType.File:
            return
        with store.open_input_file(path) as f:
            for first, cells in chunks_of(lambda at, n: f.read_at(n, at), f.size(), self.lay, partition.place, tuple(self.low), tuple(self.high)):
                where = np.argwhere(cells != self.lay.fill)
                at = where + first
                ok = ((at >= self.low) & (at < self.high)).all(1)
                yield pa.RecordBatch.from_arrays([pa.array(at[ok, k]) for k in range(3)] + [pa.array(cells[tuple(where[ok].T)].astype(np.int64))], names=["z", "y", "x", "v"])


class PushingReader(ShardReader):
    """Where Spark may hand filters down; it refuses such a reader where it may not."""

    def pushFilters(self, filters):
        """Bounds of the axes narrow the box; Spark still applies what is given back."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in AXES and isinstance(getattr(f, "value", None), int):
                k = AXES.index(name)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low[k] = max(self.low[k], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high[k] = min(self.high[k], f.value + (not isinstance(f, LessThan)))
            yield f


class ShardStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return (PushingReader if self.options.get("pushdown") == "true" else ShardReader)(self.options)


def read_shards(spark: SparkSession, root: str, low: tuple[int, ...] | None = None, size: tuple[int, ...] | None = None) -> DataFrame:
    """Cells of an array, of a half-open box of it if one is given."""
    spark.dataSource.register(ShardStore)
    reader = spark.read.format("shards").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    if low is not None and size is not None:
        reader = reader.option("low", ",".join(map(str, low))).option("size", ",".join(map(str, size)))
    return reader.load(root)


def write_shards(cells: DataFrame, root: str, shape: tuple[int, ...], file: tuple[int, ...], chunk: tuple[int, ...], dtype: str = "uint8", fill: int = 0, codecs: tuple[str, ...] = ("zstd",)) -> None:
    """Cells (z, y, x, v) as a sharded array.  A file is one group, which holds one array of
    its size; it is written beside its place and then moved there.  The array's document
    comes last."""
    store, top = pafs.FileSystem.from_uri(root)
    bytes_ = {"name": "bytes", "configuration": {"endian": "little"}}
    inner = {"chunk_shape": list(chunk), "codecs": [bytes_, *({"name": n} for n in codecs)], "index_codecs": [bytes_, {"name": "crc32c"}], "index_location": "end"}
    document = {"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype, "fill_value": fill, "attributes": {}, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(file)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "sharding_indexed", "configuration": inner}]}
    grid = tuple(f // c for f, c in zip(file, chunk, strict=True))

    def put(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        values = np.full(file, fill, dtype)
        values[tuple((x[a] - k * f).to_numpy() for a, k, f in zip(AXES, key, file, strict=True))] = x["v"]
        index, parts, at = np.full((*grid, 2), NONE, "<u8"), [], 0
        for g in np.ndindex(grid):
            part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(g, chunk, strict=True))]
            if (part != fill).any():
                parts.append(_packed(np.ascontiguousarray(part).tobytes(), codecs))
                index[g] = at, len(parts[-1])
                at += len(parts[-1])
        raw = index.tobytes()
        there, base = pafs.FileSystem.from_uri(root)
        folder = f"{base}/c/{key[0]}/{key[1]}"
        there.create_dir(folder)
        with there.open_output_stream(f"{folder}/.{key[2]}.part") as f:
            f.write(b"".join((*parts, raw, crc32c(raw).to_bytes(4, "little"))))
        there.move(f"{folder}/.{key[2]}.part", f"{folder}/{key[2]}")
        return pd.DataFrame({"cells": [len(x)]})

    keys = [F.floor(F.col(a) / f).cast("int").alias(f"f{a}") for a, f in zip(AXES, file, strict=True)]
    cells.where(F.col("v") != fill).select(*AXES, "v", *keys).groupBy(*(f"f{a}" for a in AXES)).applyInPandas(put, "cells long").agg(F.sum("cells")).collect()
    store.create_dir(top)
    with store.open_output_stream(f"{top}/zarr.json") as f:
        f.write(json.dumps(document).encode())
