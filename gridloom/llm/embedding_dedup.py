"""Classes of embeddings at a cosine of 0.9 or more: tiles in PCA order, suffix norms.

1. Equal vectors become one kind with a count, so that copies are never paired.
2. Kinds are scaled to length 1 and turned into the principal axes of all of them (second
   moments, summed up over the table), so that the leading sides hold most of a product.
3. The first ``LEAD`` sides and the norm of what follows them are a point of length 1,
   and the product of two such points is at least the cosine.  Median splits of these
   points make tiles; each tile knows the tight box of its points.
4. A kind is sent to its own tile, and visits those later ones whose box it can reach at
   the threshold; tiles of more than ``BLOCK_BYTES`` are cut into blocks.
5. Within a tile, products are accumulated over the leading sides first.  What is left is
   at most the product of both suffix norms: a pair ends as soon as its sum and this bound
   stay below the threshold.
6. A tile puts out link counts and the edges of a spanning forest, never its pairs.
   Components of all forests are found by stars.

The tree of splits is fitted on a bounded sample, and is only a layout: every kind is
compared with all that a bound does not exclude.  Pairs within ``SLACK`` of the threshold
are decided by dot / (norm * norm) on the vectors as given.

Defined cases: vectors that are null, zero or hold null or non-finite components link with
nothing and are classes of their own; rows with a null vec_id take no part (no links, null
class); vectors of unlike lengths are not compared; rows that repeat count each; an empty
table gives an empty result; other columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textkern as tk
from gridloom.llm.near_dedup import components
from gridloom.llm.scratch import Scratch

COSINE = 0.9
LEAD = 8
BLOCK_BYTES = 16 << 20
#: Most leaves of the tree of splits, and vectors that it is fitted on.
LEAVES, SAMPLE = 4096, 65_536
#: Least vectors of a tile, unless the table has fewer.
FEWEST = 256
SLACK = 1e-9
_VISITORS = 512
_PLACED = "node long, n long, dim int, leaf int, y array<double>"
_SENT = "dim int, leaf int, sub int, guest boolean, node long, n long, y array<double>"
_FOUND = "kind int, a long, b long, w long"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = b.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, b.filter(pa.array(dims == d))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, i, row: second moments of the unit vectors of one task."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for d, some in _by_dim(b):
            x = _unit(_matrix(some.column("v"), d))
            total[d] = total.get(d, 0) + x.T @ x
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(d + 1, dtype=np.int32) * d), pa.array(m.ravel()))], names=["dim", "i", "row"])


def _points(y: np.ndarray, lead: int) -> np.ndarray:
    """Leading sides and the norm of the rest."""
    return np.column_stack((y[:, :lead], np.sqrt((y[:, lead:] ** 2).sum(1))))


class Splits:
    """A tree of median splits as a complete binary tree: side and value of each node."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.depth = max(0, int(np.ceil(np.log2(max(leaves, 1)))))
        self.side, self.value = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
        held = {0: points}
        for node in range(len(self.side)):
            p = held.pop(node)
            if len(p):
                self.side[node] = int((p.max(0) - p.min(0)).argmax())
                self.value[node] = np.median(p[:, self.side[node]])
            left = p[:, self.side[node]] < self.value[node]
            held[2 * node + 1], held[2 * node + 2] = p[left], p[~left]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.side[node]] >= self.value[node])
        return node - len(self.side)


def reach(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that the product of each point with a point of length 1 in each box can be."""
    away, most = np.zeros((len(points), len(low))), np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        p, lo, hi = points[:, k, None], low[None, :, k], high[None, :, k]
        away += np.maximum(np.maximum(lo - p, p - hi), 0) ** 2
        most += np.maximum(p * lo, p * hi)
    return np.minimum(most, 1 - away / 2)


def linked(a: np.ndarray, b: np.ndarray, least: float, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, product) of all pairs with a product of ``least`` or more, up to
    rounding.  Steps double in width; while many pairs are left a step is one product of
    those rows and columns, afterwards one of pairs."""
    dim = a.shape[1]
    ends = [min(lead, dim)]
    while ends[-1] < dim:
        ends.append(min(2 * ends[-1], dim))
    rest = [[np.sqrt((x[:, e:] ** 2).sum(1)) for e in ends] for x in (a, b)]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    part = a[:, : ends[0]] @ b[:, : ends[0]].T
    i = j = None
    for k, end in enumerate(ends):
        if k and i is None:
            part = part + a[rows, ends[k - 1] : end] @ b[cols, ends[k - 1] : end].T
        elif k:
            for lo in range(0, len(i), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                part[some] += np.einsum("ij,ij->i", a[i[some], ends[k - 1] : end], b[j[some], ends[k - 1] : end])
        if i is None:
            can = part + np.outer(rest[0][k][rows], rest[1][k][cols]) >= least - SLACK
            if can.sum() * 16 > can.size and k + 1 < len(ends):
                r, c = can.any(1), can.any(0)
                rows, cols, part = rows[r], cols[c], part[np.ix_(r, c)]
                continue
            x, y = np.nonzero(can)
            i, j, part = rows[x], cols[y], part[x, y]
        else:
            can = part + rest[0][k][i] * rest[1][k][j] >= least - SLACK
            i, j, part = i[can], j[can], part[can]
    return i, j, part


def _place(models: dict[int, tuple[np.ndarray, Splits]], lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, some in _by_dim(b):
                basis, splits = models[d]
                y = _unit(_matrix(some.column("v"), d)) @ basis
                leaf = splits.leaf(_points(y, lead)) if splits else np.zeros(len(y), np.int64)
                yield pa.RecordBatch.from_arrays([some.column("node"), some.column("n"), some.column("dim"), pa.array(leaf.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * d), pa.array(y.ravel()))], names=["node", "n", "dim", "leaf", "y"])

    return run


def _boxes(lead: int):
    """dim, leaf, side, low, high, n of one task's points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for d, some in _by_dim(b):
                p, leaf = _points(_matrix(some.column("y"), d), lead), some.column("leaf").to_numpy()
                for f in np.unique(leaf).tolist():
                    q = p[leaf == f]
                    low, high, n = held.get((d, f), (np.inf, -np.inf, 0))
                    held[d, f] = [np.minimum(low, q.min(0)), np.maximum(high, q.max(0)), n + len(q)]
        for (d, f), (low, high, n) in held.items():
            k = len(low)
            yield pa.RecordBatch.from_arrays([pa.array([d] * k, pa.int32()), pa.array([f] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(low), pa.array(high), pa.array([n] * k, pa.int64())], names=["dim", "leaf", "side", "low", "high", "n"])

    return run


def _send(boxes: dict[int, tuple], lead: int, least: float):
    """Each kind to its own block, as host, and as guest to all others that it may meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, whole in _by_dim(b):
                leaves, low, high, cuts = boxes[d]
                for at in range(0, whole.num_rows, _VISITORS):
                    some = whole.slice(at, _VISITORS)
                    y, leaf, node = _matrix(some.column("y"), d), some.column("leaf").to_numpy(), some.column("node").to_numpy()
                    own = np.searchsorted(leaves, leaf)
                    sub = (tk.mix(node.astype(np.uint64)) % cuts[own].astype(np.uint64)).astype(np.int64)
                    row, box = np.nonzero((reach(_points(y, lead), low, high) >= least - SLACK) & (np.arange(len(leaves)) > own[:, None]))
                    # all blocks of a later leaf; of the own leaf those before
                    many = np.concatenate((cuts[box], sub, np.ones(len(y), np.int64)))
                    who = np.repeat(np.concatenate((row, np.arange(len(y)), np.arange(len(y)))), many)
                    to = np.repeat(np.concatenate((box, own, own)), many)
                    block = np.concatenate((tk.expand(np.zeros(len(box) + len(y), np.int64), many[: len(box) + len(y)]), sub))
                    guest = np.arange(len(who)) < len(who) - len(y)
                    cell = some.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([cell.column("dim"), pa.array(leaves[to].astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(guest), cell.column("node"), cell.column("n"), cell.column("y")], names=["dim", "leaf", "sub", "guest", "node", "n", "y"])

    return run


def joined(size: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of the component of each of ``size`` nodes under edges (u, v)."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        label = label[label]
        if (label == before).all():
            return label


def _rows(kind: int, a: np.ndarray, b: np.ndarray | None, w: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), none if b is None else pa.array(b), none if w is None else pa.array(w.astype(np.int64))], names=["kind", "a", "b", "w"])


class Tile:
    """Hosts of one block, the links found with them, and their components so far."""

    def __init__(self, node: np.ndarray, n: np.ndarray, y: np.ndarray, least: float, lead: int) -> None:
        self.node, self.n, self.y, self.least, self.lead = node, n, y, least, lead
        self.links, self.root = np.zeros(len(node)), np.arange(len(node))

    def _take(self, node: np.ndarray, n: np.ndarray, y: np.ndarray, first: int | None) -> Iterator[pa.RecordBatch]:
        """Guests, or with ``first`` the hosts from there on, each with all before it."""
        m = len(self.node)
        i, j, product = linked(self.y, y, self.least, self.lead)
        if first is not None:
            before = i < j + first
            i, j, product = i[before], j[before], product[before]
        close = np.abs(product - self.least) <= SLACK
        if close.any():
            yield _rows(2, self.node[i[close]], node[j[close]], None)
        sure = product > self.least + SLACK
        i, j = i[sure], j[sure]
        if not len(i):
            return
        self.links += np.bincount(i, n[j], m)
        mine = np.bincount(j, self.n[i], len(node))
        if first is None:
            yield _rows(0, node[mine > 0], None, mine[mine > 0])
        else:
            self.links[first : first + len(node)] += mine
        names = self.node if first is not None else np.concatenate((self.node, node))
        label = joined(len(names), np.concatenate((i, np.arange(m))), np.concatenate((j + (m if first is None else first), self.root)))
        new = np.flatnonzero(label != np.concatenate((self.root, np.arange(m, len(names)))))
        new = new[(new >= m) | (self.root[np.minimum(new, m - 1)] == new)]
        yield _rows(1, names[new], names[label[new]], None)
        self.root = label[:m]

    def guests(self, node: np.ndarray, n: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(node), _VISITORS):
            some = slice(lo, lo + _VISITORS)
            yield from self._take(node[some], n[some], y[some], None)

    def among(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.node), _VISITORS):
            some = slice(lo, lo + _VISITORS)
            yield from self._take(self.node[some], self.n[some], self.y[some], lo)

    def end(self) -> Iterator[pa.RecordBatch]:
        some = self.links > 0
        yield _rows(0, self.node[some], None, self.links[some])


def _compare(least: float, lead: int):
    """Rows come block by block, hosts before guests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hosts, tile = None, [], None

        def open_tile() -> Iterator[pa.RecordBatch]:
            nonlocal tile, hosts
            if hosts:
                tile, hosts = Tile(*(np.concatenate(c) for c in zip(*hosts, strict=True)), least, lead), []
                yield from tile.among()

        def close_tile() -> Iterator[pa.RecordBatch]:
            nonlocal tile
            yield from open_tile()
            if tile is not None:
                yield from tile.end()
            tile = None

        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "leaf", "sub", "guest")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
                if lo == hi:
                    continue
                key, some = tuple(int(c[lo]) for c in cols[:3]), b.slice(lo, hi - lo)
                if key != now:
                    yield from close_tile()
                    now = key
                part = (some.column("node").to_numpy(), some.column("n").to_numpy(), _matrix(some.column("y"), key[0]))
                if not cols[3][lo]:
                    hosts.append(part)
                    continue
                yield from open_tile()
                if tile is not None:
                    yield from tile.guests(*part)
        yield from close_tile()

    return run


def _models(kinds: DataFrame, lead: int, leaves: int | None) -> dict[int, tuple[np.ndarray, Splits | None]]:
    """For each length of vectors the principal axes, most important first, and the splits."""
    sums = kinds.mapInArrow(_moments, "dim int, i int, row array<double>").select("dim", "i", F.posexplode("row").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x"))
    held: dict[int, list] = {}
    for r in sums.toLocalIterator():
        held.setdefault(r.dim, []).append((r.i, r.j, r.x))
    counts = {r.dim: r["count"] for r in kinds.groupBy("dim").count().collect()}
    tasks = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    models = {}
    for d, cells in held.items():
        m = np.zeros((d, d))
        i, j, x = (np.array(c) for c in zip(*cells, strict=True))
        m[i, j] = x
        basis = np.linalg.eigh(m)[1][:, ::-1].copy()
        want = leaves or max(-(-counts[d] * d * 8 // BLOCK_BYTES), min(2 * tasks, counts[d] // FEWEST), 1)
        splits = None
        if want > 1:
            share = min(1.0, SAMPLE / counts[d])
            rows = kinds.where(F.col("dim") == d).sample(share, seed=1).mapInArrow(_place({d: (basis[:, :], None)}, lead), _PLACED).select(F.slice("y", 1, lead).alias("y"))
            y = np.array([r.y for r in rows.collect()]).reshape(-1, min(lead, d))
            points = np.column_stack((y, np.sqrt(np.maximum(1 - (y * y).sum(1), 0))))
            splits = Splits(points, min(want, LEAVES, max(1, len(points) // 16)))
        models[d] = (basis, splits)
    return models


def links(kinds: DataFrame, scratch: Scratch, least: float = COSINE, lead: int = LEAD, leaves: int | None = None, block: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(node, links) of the kinds that link with others, and edges (a, b) with the same
    components as all links.  kinds: node, n, dim, v."""
    placed = scratch.save(kinds.mapInArrow(_place(_models(kinds, lead, leaves), lead), _PLACED), "placed")
    found = placed.mapInArrow(_boxes(lead), "dim int, leaf int, side int, low double, high double, n long").groupBy("dim", "leaf", "side").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("dim", "leaf", "side").collect()
    boxes = {}
    for d in {r.dim for r in found}:
        mine = [r for r in found if r.dim == d]
        sides = min(lead, d) + 1
        low, high = (np.array([r[c] for r in mine]).reshape(-1, sides) for c in ("low", "high"))
        n = np.array([r.n for r in mine[::sides]])
        boxes[d] = (np.array([r.leaf for r in mine[::sides]]), low, high, np.maximum(1, -(-n * d * 8 // block)))
    sent = placed.mapInArrow(_send(boxes, lead, least), _SENT).repartition("dim", "leaf", "sub").sortWithinPartitions("dim", "leaf", "sub", "guest")
    out = scratch.save(sent.mapInArrow(_compare(least, lead), _FOUND), "found")
    body = kinds.select("node", "n", "v")
    close = out.where("kind = 2").select("a", "b").join(body.toDF("a", "n_a", "v_a"), "a").join(body.toDF("b", "n_b", "v_b"), "b")
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (s, p) -> s + p)"
    close = close.where(f"{dot('v_a', 'v_b')} / (sqrt({dot('v_a', 'v_a')}) * sqrt({dot('v_b', 'v_b')})) >= {least!r}D")
    close = scratch.save(close.select("a", "b", "n_a", "n_b"), "close")
    ends = close.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("n_b").alias("w")), F.struct(F.col("b").alias("node"), F.col("n_a").alias("w")))).alias("e")).select("e.*")
    many = out.where("kind = 0").select(F.col("a").alias("node"), "w").unionByName(ends).groupBy("node").agg(F.sum("w").alias("links"))
    return many, out.where("kind = 1").select("a", "b").unionByName(close.select("a", "b"))


def classes(vectors: DataFrame, least: float = COSINE, lead: int = LEAD, leaves: int | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    scratch = Scratch(vectors.sparkSession)
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, v.cast("array<double>")).alias("v"))
    whole, alone = rows.where("v is not null"), rows.where("v is null")
    kinds = whole.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    kinds = scratch.save(kinds.select(F.monotonically_increasing_id().alias("node"), "id", "n", F.size("v").alias("dim"), "v"), "kinds")
    many, edges = links(kinds, scratch, least, lead, leaves, block)
    part = components(edges, scratch)
    named = kinds.select("node", "id", "n").join(many, "node", "left").join(part, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = scratch.save(named, "named")
    least_id = scratch.save(named.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    known = named.join(least_id, "root").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    known = scratch.save(kinds.select("node", "v").join(known, "node").drop("node"), "known")
    out = whole.join(known, "v").select("vec_id", "n_links", "component_id")
    out = out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
