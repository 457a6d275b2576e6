"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as sequences of lower-cased words of letters, digits and multi-byte
characters.  A test item of m words may differ from a passage by e = floor(m * errors)
edits of whole words; cut into e + 1 pieces, at least one piece must occur unchanged.  One
scan of the documents hashes the word grams of all piece lengths and looks them up in a
bitmap, then in the sorted piece table; the passages around hits are verified with Myers'
bit-parallel distance (the item as the pattern, ends of the passage free), so that no pair
within the budget is lost and none beyond it is reported.

Items are sent to the executors in blocks of at most ``BLOCK_BYTES`` of text; a larger
benchmark takes more scans, never a larger broadcast.  There is no exchange.

Defined cases: null and empty items match nothing; null texts hold nothing; an item of
fewer words than 1 / errors must occur exactly; repeated items and documents are each
reported; a null doc_id or item_id is carried along; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textkern as tk
from gridloom.llm.toxicity import IS_TERM, fresh

ERRORS = 0.2
BLOCK_BYTES = 8 << 20
_BITS = 20


def myers(pattern: list[int], text: list[int], most: int) -> tuple[int, int]:
    """Least edit distance between the pattern and any part of the text, and where the
    first such part ends (exclusive); (most + 1, -1) if it is above most."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    plus, minus, score = mask, 0, m
    best, end = (m, 0) if m <= most else (most + 1, -1)
    for j, c in enumerate(text):
        x = at.get(c, 0) | minus
        d = ((plus + (x & plus)) ^ plus) | x
        d &= mask
        up = (minus | ~(d | plus)) & mask
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & mask
        down = (down << 1) & mask
        plus = (down | ~(d | up)) & mask
        minus = up & d
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """Word hashes of the items, and their pieces by length."""

    def __init__(self, ids: list, texts: list[str], errors: float) -> None:
        data, off = tk.buffers(pa.array([(t or "").lower() for t in texts], pa.string()))
        w = tk.Words(data, off, IS_TERM)
        h = w.hashes().view(np.int64).tolist()
        self.ids = ids
        self.words = [h[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
        self.budget = [int(len(x) * errors + 1e-9) for x in self.words]
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, (x, e) in enumerate(zip(self.words, self.budget, strict=True)):
            if x:
                cuts = np.linspace(0, len(x), e + 2).astype(int).tolist()
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b > a:
                        key = tk.gram_hashes(np.array(x[a:b], np.int64).view(np.uint64), b - a)[0]
                        found[b - a].append((int(key), i, a))
        self.pieces = {}
        for n, rows in found.items():
            rows.sort()
            key = np.array([r[0] for r in rows], np.uint64)
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[(key >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.pieces[n] = (bitmap, key, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def search(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, distance, end word) of the best passage of each item in each text."""
        w = tk.Words(data, off, IS_TERM)
        h = w.hashes()
        starts: dict[tuple[int, int], list[int]] = defaultdict(list)
        for n, (bitmap, key, item, place) in self.pieces.items():
            g = tk.gram_hashes(h, n)
            k = np.flatnonzero(bitmap[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
            k = k[w.row[k] == w.row[k + n - 1]]
            lo, hi = np.searchsorted(key, g[k], "left"), np.searchsorted(key, g[k], "right")
            many = np.repeat(k, hi - lo)
            which = tk.expand(lo, hi - lo)
            for r, i, s in zip(w.row[many].tolist(), item[which].tolist(), (many - place[which]).tolist(), strict=True):
                starts[r, i].append(s)
        signed = h.view(np.int64)
        for (r, i), at in starts.items():
            m, e = len(self.words[i]), self.budget[i]
            first, last = int(w.first[r]), int(w.first[r + 1])
            at.sort()
            best, end = e + 1, -1
            lo = hi = at[0]
            for s in [*at[1:], None]:
                if s is not None and s <= hi + m:  # passages that touch are read once
                    hi = s
                    continue
                a, b = max(first, lo - e), min(last, hi + m + e)
                got, where = myers(self.words[i], signed[a:b].tolist(), e)
                if got < best:
                    best, end = got, a + where - first
                lo = hi = s
            if best <= e:
                yield r, i, best, end


def _scan(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tk.buffers(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            rows = []
            for lo, hi in tk.slices(off):
                for r, i, d, end in items.search(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
                    rows.append((ids[lo + r], items.ids[i], len(items.words[i]), d, end))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "n_words", "distance", "end_word"])

    return run


def _keep(items: Items, folded: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tk.buffers(b.column(folded))
            stays = np.ones(b.num_rows, bool)
            for lo, hi in tk.slices(off):
                for r, *_ in items.search(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
                    stays[lo + r] = False
            yield b.filter(pa.array(stays))

    return run


def _blocks(benchmark: DataFrame, errors: float, block_bytes: int) -> Iterator[Items]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # about block_bytes
        yield Items([r["item_id"] for r in got], [r["text"] for r in got], errors)


def matches(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item within the budget: doc_id, item_id, n_words (of
    the item), distance, end_word (where the best passage ends)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    found = [rows.mapInArrow(_scan(items), "doc_id long, item_id long, n_words int, distance int, end_word int") for items in _blocks(benchmark, errors, block_bytes)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs whose text holds no item, in one scan for each block of items."""
    folded = fresh(docs, "folded")
    out = docs.withColumn(folded, F.lower(F.coalesce("text", F.lit(""))))
    for items in _blocks(benchmark, errors, block_bytes):
        out = out.mapInArrow(_keep(items, folded), out.schema)
    return out.select(*docs.columns)
