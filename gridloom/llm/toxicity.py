"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their first 3 to 7 bytes, hashed into
2 ** ``BUCKET_BITS`` buckets.  The machine learns a weight for each input bucket and,
through ``FACTORS`` numbers for each, one for every pair of them.  Inputs are all buckets
whose share of documents differs by label (|z| of ``MIN_Z`` or more), and all buckets of
pairs that differ by label far more than either bucket does (``pair_terms``): two terms
that are harmless alone may count together.  How many there are is left to the data.

Training reads labelled rows in order of a hash, at most ``SAMPLE`` of them and at most
``SAMPLE_BYTES`` of text in all; pairs are looked for among at most ``PAIR_ROWS`` rows of
either label, and in terms that ``PAIR_SHARE`` of them hold.  The sample bounds the model
that is sent to the executors.  Scoring is one pass over whole texts without any exchange.

Defined cases: null and empty texts get the score of a text without terms; rows without a
label, or with a null doc_id, teach nothing; with no labelled row, or one class alone, the
score is the smoothed share of label 1; several labels of one doc_id count as their
largest; rows of one doc_id with unlike texts each teach; very long texts are scored
whole; an empty table gives an empty result; columns besides doc_id and text, of any name,
are not read (``clean`` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.llm import textkern as tk

SAMPLE = 10_000
SAMPLE_BYTES = 64 << 20
BUCKET_BITS = 20
FACTORS = 8
PREFIXES = (3, 4, 5, 6, 7)
MIN_Z = 4.0
PAIR_ROWS, PAIR_SHARE = 1000, 0.03
#: |z| that a pair needs, and how far it must be above that of its terms.
PAIR_Z, PAIR_MORE = 6.0, 2.0

#: Word bytes are letters, digits and all of multi-byte characters.
IS_TERM = np.zeros(256, bool)
IS_TERM[128:] = True
for _lo, _hi in ("09", "AZ", "az"):
    IS_TERM[ord(_lo) : ord(_hi) + 1] = True


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs do not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(column: str = "doc_id", parts: int = 5):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every term, repeated ones too."""
    w = tk.Words(data, off, IS_TERM)
    shift = np.uint64(64 - BUCKET_BITS)
    rows, buckets = [w.row], [w.hashes() >> shift]
    for n in PREFIXES:
        k = np.flatnonzero(w.end - w.start > n)
        s = w.start[k]
        rows.append(w.row[k])
        buckets.append(tk.hash_ranges(data, s, s + n, salt=n) >> shift)
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def _distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row.astype(np.int64) << BUCKET_BITS) | bucket)
    return both >> BUCKET_BITS, both & ((1 << BUCKET_BITS) - 1)


@dataclass
class Machine:
    bias: float
    inputs: np.ndarray  # sorted buckets
    weight: np.ndarray
    factor: np.ndarray

    def score(self, rows: int, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Rows in order, buckets distinct in each row."""
        z = np.full(rows, self.bias)
        if len(self.inputs):
            at = np.minimum(np.searchsorted(self.inputs, bucket), len(self.inputs) - 1)
            hit = self.inputs[at] == bucket
            row, at = row[hit], at[hit]
            z += np.bincount(row, self.weight[at], rows)
            for v in self.factor.T:
                z += 0.5 * (np.bincount(row, v[at], rows) ** 2 - np.bincount(row, v[at] ** 2, rows))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(row: np.ndarray, at: np.ndarray, y: np.ndarray, inputs: np.ndarray, rounds: int = 150, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the log loss; entries (row, place in inputs) in order of rows."""
    n, k = len(y), len(inputs)
    rng = np.random.Generator(np.random.PCG64(seed))
    share = (y.sum() + 0.5) / (n + 1)
    p = [np.array([np.log(share / (1 - share))]), np.zeros(k), rng.normal(0, 0.05, (k, FACTORS))]
    m, s = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
    sums = lambda to, of, weight, size: np.stack([np.bincount(to, w[of], size) for w in weight.T], 1)  # noqa: E731  (a factor at a time, to hold little)
    for t in range(1, rounds + 1):
        q = sums(row, at, p[2], n)
        z = p[0] + np.bincount(row, p[1][at] - 0.5 * (p[2] ** 2).sum(1)[at], n) + 0.5 * (q * q).sum(1)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        each = np.bincount(at, e[row], k)
        g = [np.array([e.sum()]), each + decay * p[1], sums(at, row, e[:, None] * q, k) - each[:, None] * p[2] + decay * p[2]]
        for i in range(3):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            s[i] = 0.999 * s[i] + 0.001 * g[i] ** 2
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return Machine(float(p[0][0]), inputs, p[1], p[2])


def _parts(start: np.ndarray, bucket: np.ndarray, step: int = 500) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of the entries, some rows at a time, so that copies stay small."""
    for lo in range(0, len(start) - 1, step):
        hi = min(lo + step, len(start) - 1)
        yield np.repeat(np.arange(lo, hi, dtype=np.int32), np.diff(start[lo : hi + 1])), bucket[start[lo] : start[hi]]


def single_z(start: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> np.ndarray:
    """z of the difference of document shares, of every bucket."""
    n1, n0 = y.sum(), len(y) - y.sum()
    c, c1 = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    for row, some in _parts(start, bucket):
        c += np.bincount(some, minlength=len(c))
        c1 += np.bincount(some[y[row] > 0], minlength=len(c))
    both = c / len(y)
    return (c1 / n1 - (c - c1) / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)


def pair_terms(start: np.ndarray, bucket: np.ndarray, y: np.ndarray, rows: int = PAIR_ROWS, step: int = 128) -> np.ndarray:
    """Buckets of pairs whose share differs by label far more than that of either bucket."""
    some = [np.flatnonzero(y == label)[:rows] for label in (0, 1)]
    size = np.diff(start)
    cells = [(np.repeat(np.arange(len(d)), size[d]), bucket[tk.expand(start[d], size[d])]) for d in some]
    count = np.stack([np.bincount(b, minlength=1 << BUCKET_BITS) for _, b in cells])
    n = np.array([len(d) for d in some], np.float32)
    terms = np.flatnonzero((count >= np.maximum(PAIR_SHARE * n, 5)[:, None]).any(0))

    def z(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        share = (a + b) / n.sum()
        return (b / n[1] - a / n[0]) / np.sqrt(share * (1 - share) * (1 / n).sum() + np.float32(1e-9))

    alone = z(*count[:, terms].astype(np.float32))
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    dense = []
    for (r, b), d in zip(cells, some, strict=True):
        x, k = np.zeros((len(terms), len(d)), np.float32), place[b] >= 0
        x[place[b[k]], r[k]] = 1
        dense.append(x)
    found: set[int] = set()
    for lo in range(0, len(terms), step):
        both = z(*(x[lo:] @ x[lo : lo + step].T for x in dense))
        beats = np.abs(both) >= np.maximum(PAIR_Z, np.maximum(np.abs(alone[lo:])[:, None], np.abs(alone[lo : lo + step])[None]) + PAIR_MORE)
        i, j = np.nonzero(beats)
        found.update((lo + np.unique(np.concatenate((i, j)))).tolist())
    return terms[sorted(found)]


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = tk.buffers(b.column("text"))
        parts = []
        for lo, hi in tk.slices(off):
            row, bucket = _distinct(*_terms(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
            bounds = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket.astype(np.int32))))
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))], names=["h", "y", "buckets"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, parts: int = 5) -> Machine:
    """Learns from labelled rows of documents outside fold 0."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(parts=parts) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("y"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.lower(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(taken), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "y", "text")  # at most `sample` narrow rows
    sizes = rows.select("h", "y", F.octet_length("text").alias("n")).orderBy("h").limit(sample).collect()
    total, last = 0, None
    for r in sizes:
        total += r["n"]
        if last is not None and total > sample_bytes:
            break
        last = r["h"]
    if last is None or len({r["y"] for r in sizes if r["h"] <= last}) < 2:
        n1, n = sum(r["y"] for r in sizes), len(sizes)
        return Machine(float(np.log((n1 + 0.5) / (n - n1 + 0.5))) if n else 0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    got = rows.where(F.col("h") <= last).mapInArrow(_buckets_of, "h long, y long, buckets array<int>").toArrow().combine_chunks().sort_by("h")  # arrival order must not matter
    lists = got["buckets"].combine_chunks()
    start = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64)
    bucket, y = lists.flatten().to_numpy().copy(), got["y"].to_numpy().astype(np.float64)
    del got, lists
    pa.default_memory_pool().release_unused()
    return learn(start, bucket, y)


def learn(start: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> Machine:
    """Chooses inputs and trains; row i holds the distinct buckets start[i] to start[i + 1]."""
    inputs = np.union1d(np.flatnonzero(np.abs(single_z(start, bucket, y)) >= MIN_Z), pair_terms(start, bucket, y))
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[inputs] = np.arange(len(inputs))
    rows, places = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for row, some in _parts(start, bucket):
        at = place[some]
        rows.append(row[at >= 0])
        places.append(at[at >= 0])
    return train(np.concatenate(rows), np.concatenate(places), y, inputs)


def score(docs: DataFrame, machine: Machine, out: str = "score") -> DataFrame:
    """The columns of docs and the score, in a column of a name that docs do not have."""
    folded = fresh(docs, "folded")
    rows = docs.withColumn(folded, F.lower(F.coalesce("text", F.lit(""))))

    sent = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tk.buffers(b.column(folded))
            z = np.zeros(b.num_rows)
            for lo, hi in tk.slices(off):
                z[lo:hi] = sent.value.score(hi - lo, *_distinct(*_terms(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])))
            keep = [c for c in b.schema.names if c != folded]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(z)], names=[*keep, out])

    return rows.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold."""
    name = fresh(docs, "score")
    return score(docs, fit(docs, labels), name).where(F.col(name) < threshold).select(*docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, parts=parts))
    return scored.select("doc_id", (fold(parts=parts) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
