"""A data source for arrays stored as one raw file a chunk.

The root holds ``array.json`` (shape, chunk, dtype, fill, compression) and files named
``cz.cy.cx``; a chunk of fill values only has no file.  ``spark.read.format("rawstore")``
gives (z, y, x, v) of all cells that are not fill; the options ``low`` and ``size``
("z,y,x") restrict it to a half-open box, of which chunks outside are never opened.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import product
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "z bigint, y bigint, x bigint, v bigint"


class ChunkPartition(InputPartition):
    def __init__(self, chunk: tuple[int, int, int]) -> None:
        self.chunk = chunk


class RawReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = Path(options["path"])
        self.meta = json.loads((self.root / "array.json").read_text())
        numbers = lambda k, d: tuple(int(i) for i in options[k].split(",")) if k in options else d
        self.low = numbers("low", (0, 0, 0))
        size = numbers("size", tuple(self.meta["shape"]))
        self.high = tuple(min(a + n, s) for a, n, s in zip(self.low, size, self.meta["shape"], strict=True))

    def partitions(self) -> list[ChunkPartition]:
        side = self.meta["chunk"]
        spans = [range(max(0, a) // c, -(-b // c)) for a, b, c in zip(self.low, self.high, side, strict=True)]
        return [ChunkPartition(c) for c in product(*spans) if (self.root / ".".join(map(str, c))).exists()]

    def read(self, partition: ChunkPartition) -> Iterator[pa.RecordBatch]:
        raw = (self.root / ".".join(map(str, partition.chunk))).read_bytes()
        if self.meta.get("compression") == "zlib":
            raw = zlib.decompress(raw)
        cells = np.frombuffer(raw, self.meta["dtype"]).reshape(self.meta["chunk"])
        at = np.argwhere(cells != self.meta["fill"])
        where = at + np.array(partition.chunk) * np.array(self.meta["chunk"])
        ok = ((where >= self.low) & (where < self.high)).all(1)
        at, where = at[ok], where[ok]
        yield pa.RecordBatch.from_arrays([pa.array(where[:, k]) for k in range(3)] + [pa.array(cells[tuple(at.T)].astype(np.int64))], names=["z", "y", "x", "v"])


class RawStore(DataSource):
    """Register with ``spark.dataSource.register(RawStore)``."""

    @classmethod
    def name(cls) -> str:
        return "rawstore"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)


def write_raw(df: DataFrame, root: str, shape: tuple[int, ...], chunk: tuple[int, ...], fill: int = 0, dtype: str = "uint8") -> None:
    """Writes (z, y, x, v) cells; each chunk is one group and one file, published by rename."""
    Path(root).mkdir(parents=True, exist_ok=True)
    keys = [F.floor(F.col(a) / c).cast("int").alias(f"c{a}") for a, c in zip("zyx", chunk, strict=True)]

    def put(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        cells = np.full(chunk, fill, dtype)
        cells[tuple((x[a] - k * c).to_numpy() for a, k, c in zip("zyx", key, chunk, strict=True))] = x["v"]
        path = Path(root) / ".".join(map(str, key))
        part = path.with_suffix(path.suffix + ".part")
        part.write_bytes(zlib.compress(cells.tobytes(), 1))
        part.rename(path)
        return x.iloc[:0][["v"]].assign(v=0)

    df.where(F.col("v") != fill).select("z", "y", "x", "v", *keys).groupBy("cz", "cy", "cx").applyInPandas(put, "v long").count()
    (Path(root) / "array.json").write_text(json.dumps({"shape": list(shape), "chunk": list(chunk), "dtype": dtype, "fill": fill, "compression": "zlib"}))
