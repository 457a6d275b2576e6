"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Shingles are five consecutive words, weighted by how often a text holds them; two texts
are linked if their probability Jaccard similarity is 0.8 or more.  (For texts without
repeated shingles it equals the Jaccard similarity of the shingle sets.)

1. Exact copies meet by digest; only the smallest doc_id of each text goes on as a node.
2. A text's signature has ``BANDS * ROWS`` registers.  Every shingle is a Poisson process
   whose rate is its weight; each arrival falls into a random register, which keeps its
   earliest.  A shingle stops as soon as its next arrival is later than all registers.
3. Nodes that agree on a whole band are candidates.  A bucket of up to ``SMALL`` nodes
   gives all its pairs.  A larger one gives the pairs with its centre, the node that meets
   most others in large buckets.  Once those are verified and joined into components,
   what large buckets still hold in several components is settled in full: components
   that meet in a large bucket form a family, whose nodes are cut into blocks of about
   ``BLOCK`` bytes, and any two blocks that can hold a pair across components are
   compared, every such pair of theirs.  A group of copies thus never gives its pairs.
4. Candidates are verified on whole texts with the exact probability Jaccard similarity.
5. Components are found by alternating stars, with a table in the shared folder a round;
   nothing but counters reaches the driver.

A pair at similarity s shares no band with probability (1 - s**ROWS)**BANDS, which is
5e-5 at 0.8.

Defined cases: texts of fewer than five words are one shingle of all their words; texts
without any word (null, empty, blank) are in no class but their own; a null doc_id takes
no part and has a null class; a doc_id with several texts is one document for ``classes``,
whose class holds them all, while ``clean`` judges each text of its own; very long texts
are read whole; an empty table gives an empty result; columns besides doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import textkern as tk
from gridloom.llm.scratch import Scratch, saved
from gridloom.llm.toxicity import fresh

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
SMALL = 16
BLOCK = 4 << 20
#: What a node adds to the size of its block, so that blocks of short texts stay small.
NODE_BYTES = 1024


def shingles(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle, repeated ones too."""
    w = tk.Words(data, off)
    h = w.hashes()
    rows, out = [], []
    g = tk.gram_hashes(h, words)
    k = np.flatnonzero(w.row[: len(g)] == w.row[words - 1 :]) if len(g) else np.zeros(0, np.int64)
    rows.append(w.row[k])
    out.append(g[k])
    for n in range(1, words):
        short = np.flatnonzero(w.count == n)
        if len(short):
            rows.append(short)
            out.append(tk.gram_hashes(h, n)[w.first[short]])
    return np.concatenate(rows), np.concatenate(out)


def signatures(row: np.ndarray, gram: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """rows x size registers, each the shingle of the earliest arrival; and which rows have
    any shingle."""
    _, at, weight = np.unique(tk.mix(gram ^ tk.mix(row.astype(np.uint64))), return_index=True, return_counts=True)
    row, gram = row[at], gram[at]
    value = np.full(rows * size, np.inf)
    out = np.zeros(rows * size, np.uint64)
    time, turn = np.zeros(len(row)), 0
    while len(row):
        turn += 1
        dice = tk.mix(gram + np.uint64((turn * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        time = time - np.log(((dice >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
        register = row * size + (tk.mix(dice) % np.uint64(size)).astype(np.int64)
        np.minimum.at(value, register, time)
        won = time == value[register]
        out[register[won]] = gram[won]
        last = value.reshape(rows, size).max(1)
        go = time < last[row]
        row, gram, weight, time = row[go], gram[go], weight[go], time[go]
    value = value.reshape(rows, size)
    return out.reshape(rows, size), np.isfinite(value[:, 0])


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two shingle multisets, each as sorted distinct hashes and counts: the sum over
    common x of 1 / sum over y of max(a_y / a_x, b_y / b_x)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    below = np.searchsorted(ratio, ratio, "right")
    left = np.concatenate(([0], np.cumsum(x)))[below] + only_a
    right = (y.sum() - np.concatenate(([0], np.cumsum(y)))[below]) + only_b
    return float((1 / (left / x + right / y)).sum())


def _sign(bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tk.buffers(b.column("text"))
            parts: list[pa.Array] = []
            for lo, hi in tk.slices(off):
                sig, some = signatures(*shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words), hi - lo, bands * rows)
                step = tk._words.upto(rows + 1)[0]
                key = tk.mix((sig.reshape(hi - lo, bands, rows) * step[1:]).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
                count = np.where(some, bands, 0)
                bounds = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(tk.signed(key[some].reshape(-1)))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))], names=["doc_id", "digest", "bands"])

    return run


def _verify(words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

            def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
                raw = text.encode()
                got = known.get(raw)
                if got is None:
                    data = np.frombuffer(raw, np.uint8)
                    got = np.unique(shingles(data, np.array([0, len(data)]), words)[1], return_counts=True)
                    if len(known) > 256:
                        known.clear()
                    known[raw] = got
                return got

            keep = [probability_jaccard(grams(x.as_py()), grams(y.as_py())) >= least - 1e-12 for x, y in zip(b.column("text_a"), b.column("text_b"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def common_mass(row: np.ndarray, col: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Shares of left's weight on shingles that right holds too, and of right's on left's;
    entries are sorted by shingle."""
    total = np.bincount(row, weight, max(left.max(), right.max()) + 1)
    both = np.zeros((2, len(left), len(right)), np.float32)
    at = np.full((2, len(total)), -1)
    at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
    seen = [np.isin(np.arange(col[-1] + 1 if len(col) else 0), col[at[k, row] >= 0]) for k in (0, 1)]
    cols = np.flatnonzero(seen[0] & seen[1])
    for lo in range(0, len(cols), step):
        some = cols[lo : lo + step]
        a, b = np.searchsorted(col, some[0]), np.searchsorted(col, some[-1], "right")
        place = np.minimum(np.searchsorted(some, col[a:b]), len(some) - 1)
        here = some[place] == col[a:b]
        m = []
        for k, rows in ((0, left), (1, right)):
            mine = here & (at[k, row[a:b]] >= 0)
            x = np.zeros((len(rows), len(some)), np.float32)
            x[at[k, row[a:b][mine]], place[mine]] = weight[a:b][mine] / total[row[a:b][mine]]
            m.append(x)
        both[0] += m[0] @ (m[1] > 0).T.astype(np.float32)
        both[1] += (m[0] > 0).astype(np.float32) @ m[1].T
    return both[0], both[1]


def _settle(words: int, least: float):
    """Links that join the components of two blocks.  With the shares u and v of their
    weights on common shingles, two texts are at most 1 / (1 / u + 1 / v - 1) similar; the
    pairs that this bound admits are verified, unless links have joined them before."""

    def run(t: pa.Table) -> pa.Table:
        side, node, part = (t.column(c).to_numpy() for c in ("side", "node", "part"))
        data, off = tk.buffers(t.column("text").combine_chunks())
        found = [(lo, *shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)) for lo, hi in tk.slices(off)]
        row = np.concatenate([lo + r for lo, r, _ in found])
        kinds, col = np.unique(np.concatenate([g for *_, g in found]), return_inverse=True)
        cell, weight = np.unique(col.astype(np.int64) * len(node) + row, return_counts=True)
        col, row = cell // len(node), cell % len(node)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        u, v = common_mass(row, col, weight, left, right)
        with np.errstate(divide="ignore"):
            can = (1 / (1 / u + 1 / v - 1) >= least - 1e-4) & (part[left][:, None] != part[right][None])
        order = np.argsort(row, kind="stable")
        bound = np.searchsorted(row[order], np.arange(len(node) + 1))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                x = y
            return x

        def held(i: int) -> tuple[np.ndarray, np.ndarray]:
            k = order[bound[i] : bound[i + 1]]
            return col[k], weight[k]

        links = []
        for i, j in zip(*np.nonzero(can), strict=True):
            i, j = left[i], right[j]
            x, y = find(int(part[i])), find(int(part[j]))
            if x != y and probability_jaccard(held(i), held(j)) >= least - 1e-12:
                root[max(x, y)] = min(x, y)
                links.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, root (the component's smallest node) of all nodes that edges (a, b) name, by
    large and small stars in turn."""
    scratch = scratch or Scratch(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = scratch.save(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = scratch.save(small, "edges")
        scratch.drop(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _paired(wanted: DataFrame, body: DataFrame) -> DataFrame:
    """The texts of both nodes of each pair."""
    left = wanted.join(body.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(body.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b")


def _duels(meet: DataFrame, body: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """Blocks (p, q) of nodes that share a family, side by side: every pair of nodes of
    unlike parts is in some block pair.  meet: bucket, node, part and x, the bucket's least
    part, of buckets that hold several parts."""
    family = components(meet.select(F.col("x").alias("a"), F.col("part").alias("b")), scratch)
    inside = meet.select("node", "part").distinct().join(family.select(F.col("node").alias("part"), F.col("root").alias("family")), "part")
    held = scratch.save(inside.join(body, "node").select("node", "part", "family", "text"), "family")
    size = scratch.save(held.groupBy("family", "part").agg(F.sum(F.octet_length("text") + NODE_BYTES).alias("size")), "size")
    little = size.where(F.col("size") <= block).groupBy("family").agg(F.ceil(F.sum("size") / block).alias("cuts"))
    own = F.when(F.col("size") > block, F.col("part"))
    cut = scratch.save(size.join(little, "family", "left").select("family", "part", own.alias("own"), F.when(own.isNotNull(), F.ceil(F.col("size") / block)).otherwise(F.col("cuts")).alias("cuts")), "cut")
    at = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("part")).otherwise(F.col("node"))), F.col("cuts"))
    placed = held.join(cut, ["family", "part"]).select("node", "part", "text", F.struct("family", "own", at.alias("no")).alias("block"))
    blocks = placed.select("block").distinct()
    first, second = (blocks.select(F.col("block.family").alias("family"), F.col("block").alias(k)) for k in "pq")
    duels = scratch.save(first.join(second, "family").where("p <= q and (p.own is null or q.own is null or p.own <> q.own)").select("p", "q"), "duels")
    left = placed.join(duels, F.col("block") == F.col("p")).withColumn("side", F.lit(0))
    right = placed.join(duels.where("p <> q"), F.col("block") == F.col("q")).withColumn("side", F.lit(1))
    return left.unionByName(right).select("p", "q", "side", "node", "part", "text")


def text_classes(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, small: int = SMALL, block: int = BLOCK, whole_ids: bool = False) -> DataFrame:
    """doc_id, digest, root of every text of every doc_id: equal roots are one class.  With
    whole_ids the texts of one doc_id belong together."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    known = keyed.where(F.col("doc_id").isNotNull())
    signed = known.mapInArrow(_sign(bands, rows, words), "doc_id long, digest binary, bands array<long>").where(F.size("bands") > 0)
    nodes = signed.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    nodes = first = scratch.save(nodes.withColumn("node", F.col("id")), "nodes")
    # several texts under one doc_id: all but one get a number of their own, above all ids
    twins = scratch.save(nodes.groupBy("id").agg(F.min("digest").alias("main"), F.count("*").alias("n")).where("n > 1").select("id", "main"), "twins")
    if not twins.isEmpty():
        number = F.when(F.col("main") != F.col("digest"), F.xxhash64("id", "digest").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)).otherwise(F.col("id"))
        nodes = scratch.save(nodes.join(twins, "id", "left").select("digest", "id", "bands", number.alias("node")), "nodes")
        scratch.drop(first)

    bucket = nodes.select("node", F.explode("bands").alias("bucket"))
    sized = scratch.save(bucket.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sized")  # as a plain side, so that Spark can split the other
    held = scratch.save(bucket.join(sized, "bucket").select("bucket", "node", "n"), "held")
    few = held.where(F.col("n") <= small).groupBy("bucket").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    pairs = few.select(F.explode(F.expr("flatten(transform(nodes, (x, i) -> transform(slice(nodes, i + 2, size(nodes)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    wide = held.where(F.col("n") > small)
    # the node that meets most others is the likeliest centre of a group of copies
    centre = scratch.save(wide.join(wide.groupBy("node").agg(F.sum("n").alias("meets")), "node").groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("meets"), "node")).alias("lead")), "centre")
    stars = wide.join(centre, "bucket").where("lead <> node").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
    wanted = scratch.save(pairs.unionByName(stars).distinct(), "wanted")
    wide = scratch.save(wide.select("bucket", "node"), "wide")
    scratch.drop(sized, centre)

    member = scratch.save(known.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").select("doc_id", "node", "digest"), "member")
    # texts of the nodes that any bucket brings together, one row each
    asked = nodes.select("id", "digest", "node").join(held.select("node").distinct(), "node", "left_semi")
    body = known.select(F.col("doc_id").alias("id"), "digest", "text").join(asked, ["id", "digest"]).dropDuplicates(["node"]).select("node", "text")
    body = scratch.save(body, "body")
    scratch.drop(held, nodes)

    links = _paired(wanted, body).mapInArrow(_verify(words, least), "a long, b long")
    if whole_ids:
        several = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
        links = links.unionByName(member.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b"))
    links = scratch.save(links, "links")
    scratch.drop(wanted)
    parts = components(links, scratch)

    # every pair across components that meet in a large bucket
    part = scratch.save(wide.join(parts, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("part")), "part")
    mixed = scratch.save(part.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("bucket", "x"), "mixed")
    if not mixed.isEmpty():
        sides = _duels(part.join(mixed, "bucket"), body, scratch, block)
        found = scratch.save(sides.groupBy("p", "q").applyInArrow(_settle(words, least), "a long, b long"), "found")
        parts = components(links.unionByName(found), scratch)
    scratch.drop(wide, body, part)
    return member.join(parts, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, **more) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) of every document that has words."""
    return text_classes(docs, whole_ids=True, **more).groupBy("doc_id").agg(F.min("root").alias("class_id"))


def classes(docs: DataFrame, **more) -> DataFrame:
    """doc_id, class_id of every row of docs."""
    member = near_duplicates(docs, **more)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(member, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def clean(docs: DataFrame, **more) -> DataFrame:
    """One row of each class, that with the smallest doc_id (then digest); rows of one doc_id
    with unlike texts are judged by their texts.  Rows with a null doc_id or without words
    stay."""
    found, place, digest = text_classes(docs, **more), fresh(docs, "place"), fresh(docs, "digest")
    best = saved(found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("best")), "best")  # a plain side, as above
    losers = found.join(best, "root").where(F.struct("doc_id", "digest") != F.col("best")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    mine = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.where(F.col("doc_id").isNotNull()).withColumn(digest, mine)
    kept = rows.join(losers, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col(digest) == F.col("__digest")), "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(F.lit(1)))
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = kept.withColumn(place, F.when(worded, first).otherwise(1)).where(F.col(place) == 1).select(*docs.columns)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
