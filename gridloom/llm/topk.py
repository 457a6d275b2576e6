"""Exact top-k by inner product with KD-trees over shards.

Vectors are made of integers, floor(256 x).  Candidates are dealt by hash into shards of
about ``SHARD`` vectors.  A shard builds one KD-tree by median splits of the widest side,
with a tight box a node; queries then stream past it.  The inner product of a query with
any vector of a box is at most the sum over sides of the larger product with the box's two
ends.  Each query goes down the tree best first: it opens the node with the highest bound,
puts its children into its queue and scores leaves, until the best bound is below its k-th
score.  A few shards are searched beforehand, and the k-th scores found there go along
with the queries to all others.

Scores are exact: products run in float64 while no sum can leave the integers that it
holds, else in 64-bit integers, else in Python's own integers (a score outside 64 bits is
put out as the nearest of them, and ranked by its true value within its shard).

Defined cases: vectors that are null, or hold null or non-finite components, and rows
with a null vec_id take no part; vectors of unlike lengths are not compared; a query never
meets rows of its own vec_id; other repeated rows each count; of several rows with one
query id the smallest vector asks; ties go to the smaller vec_id; an empty table gives an
empty result; other columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch

K = 5
SHARD, LEAF = 32_768, 256
#: Shards searched beforehand.
FIRST = 2
SCALE = 256.0
#: Queries that go past a tree at once.
_QUERIES = 1024
_ROWS = "shard int, dim int, query boolean, id long, v array<double>, floor long"
_OUT = "query_id long, vec_id long, score long"
_TOP, _BOTTOM = (1 << 63) - 1, -(1 << 63)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as whole numbers, in float64 if those hold them, else as Python's integers."""
    x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), dim)
    if np.isinf(x).any():  # 256 x is beyond float64
        x = np.array([int(v) * int(SCALE) for v in column.flatten().to_pylist()], object).reshape(x.shape)
    elif x.size and np.abs(x).max() >= 2.0**62:
        x = np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return x


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


class Tree:
    """A KD-tree over the rows of x: children (-1 for leaves), rows and tight box of each
    node.  Rows must be in order of ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> None:
        self.ids, self.x, self.rows, self.child, low, high = ids, x, [], [], [], []
        stack: list[tuple[int, int, np.ndarray]] = [(-1, 0, np.arange(len(x)))]
        while stack:
            parent, which, rows = stack.pop()
            node = len(self.rows)
            if parent >= 0:
                self.child[parent][which] = node
            self.child.append([-1, -1])
            low.append(x[rows].min(0))
            high.append(x[rows].max(0))
            self.rows.append(np.sort(rows))
            if len(rows) > leaf:
                spread = high[-1] - low[-1]
                order = np.argsort(x[rows, int(spread.argmax())] if len(spread) else rows, kind="stable")  # equal vectors are cut by place
                half = len(rows) // 2
                stack += [(node, 0, rows[order[:half]]), (node, 1, rows[order[half:]])]
        self.child, self.low, self.high = np.array(self.child), np.stack(low), np.stack(high)
        self.most = _largest(x)

    def _bound(self, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The highest score that each query can have in the box of its node."""
        return np.maximum(q * self.low[node], q * self.high[node]).sum(1)

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of up to k best rows each; scores below a query's floor may
        be left out."""
        reach = self.most * _largest(q) * max(1, q.shape[1])
        kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 62 else object
        x, n = self.x.astype(kind, copy=False), len(q)
        q = q.astype(kind, copy=False)
        low, high = self.low, self.high
        self.low, self.high = low.astype(kind), high.astype(kind)
        none = -reach - 1
        kth = np.maximum(floor.astype(kind), none) if kind is not np.float64 else np.maximum(floor.astype(np.float64), none)
        queue = np.full((n, len(self.rows)), none, kind)
        queue[:, 0] = self._bound(q, np.zeros(n, np.int64))
        score, row = np.full((n, k), none, kind), np.full((n, k), len(x), np.int64)
        while True:
            best = queue.argmax(1)
            value = queue[np.arange(n), best]
            open_ = np.flatnonzero((value > none) & (value >= kth))
            if not len(open_):
                break
            node = best[open_]
            queue[open_, node] = none
            inner = self.child[node, 0] >= 0
            for side in (0, 1):
                c = self.child[node[inner], side]
                queue[open_[inner], c] = self._bound(q[open_[inner]], c)
            for leaf in np.unique(node[~inner]):
                mine, rows = open_[node == leaf], self.rows[leaf]
                got = q[mine] @ x[rows].T
                take = (got >= kth[mine][:, None]) & (q_ids[mine][:, None] != self.ids[rows][None])
                a, b = np.nonzero(take)
                # the best k of what was held and what was found, ties by id
                who = np.concatenate((np.repeat(np.arange(len(mine)), k), a))
                s, r = np.concatenate((score[mine].ravel(), got[a, b])), np.concatenate((row[mine].ravel(), rows[b]))
                order = np.lexsort((r, -s, who)) if kind is not object else np.array(sorted(range(len(s)), key=lambda i: (who[i], -s[i], r[i])), np.int64)
                first = np.searchsorted(who[order], np.arange(len(mine)))
                top = order[first[:, None] + np.arange(k)]
                score[mine], row[mine] = s[top], r[top]
                kth[mine] = np.maximum(kth[mine], np.where(row[mine, -1] < len(x), score[mine, -1], none))
        self.low, self.high = low, high
        at, place = np.nonzero(row < len(x))
        return at, row[at, place], np.array([min(max(int(v), _BOTTOM), _TOP) for v in score[at, place]], np.int64) if kind is object else score[at, place].astype(np.int64)


def _search(k: int):
    """Rows come shard by shard, the candidates of each before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, tree = None, [], None
        for b in batches:
            shard, dim = b.column("shard").to_numpy(), b.column("dim").to_numpy()
            asks = b.column("query").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
                if lo == hi:
                    continue
                key, part = (int(shard[lo]), int(dim[lo])), b.slice(lo, hi - lo)
                if key != open_key:
                    open_key, held, tree = key, [], None
                ids, x = part.column("id").to_numpy(), _matrix(part.column("v"), key[1])
                if not asks[lo]:
                    held.append((ids, x))
                    continue
                if tree is None and held:
                    all_ids, all_x = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(all_ids, kind="stable")
                    tree, held = Tree(all_ids[order], all_x[order]), []
                if tree is None:
                    continue
                floor = part.column("floor").fill_null(_BOTTOM // 2).to_numpy()
                for i in range(0, len(ids), _QUERIES):
                    some = slice(i, i + _QUERIES)
                    at, row, score = tree.search(ids[some], x[some], floor[some], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][at]), pa.array(tree.ids[row]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = 50, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose vec_id is divisible by
    ``every``, candidates all rows."""
    shards = max(1, -(-vectors.count() // shard))
    v = F.col("embedding")
    sound = v.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    held = rows.withColumns({"shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "query": F.lit(False), "floor": F.lit(None).cast("long")})

    def meet(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        both = candidates.select(*columns).unionByName(queries.withColumn("query", F.lit(True)).select(*columns))
        return both.repartition("shard", "dim").sortWithinPartitions("shard", "dim", "query").mapInArrow(_search(k), _OUT)

    def to(first: int, last: int, queries: DataFrame) -> DataFrame:
        return queries.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last))))

    first = min(FIRST, shards)
    found = meet(held.where(F.col("shard") < first), to(0, first - 1, asked.withColumn("floor", F.lit(None).cast("long"))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    if shards > first:
        best = Scratch(vectors.sparkSession).save(best, "first").drop("rank")
        known = best.groupBy(F.col("query_id").alias("id")).agg(F.expr(f"case when count(*) >= {k} and min(score) > {_BOTTOM + 1} then min(score) end").alias("floor"))
        rest = meet(held.where(F.col("shard") >= first), to(first, shards - 1, asked.join(known, "id", "left")))
        best = best.unionByName(rest).withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
