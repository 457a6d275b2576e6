"""Language-model scores by deleted interpolation.

Tokens are words with A-Z in lower case and one end a text.  The probability of a token
after another is mixed from the maximum-likelihood estimates of the pair, of the token
alone and of a uniform choice among all known tokens and one unknown:

    P(t | c) = l2[b] n(c t) / n(c) + l1[b] n(t) / N + l0[b] / (V + 1),

where b is the bucket of n(c), a power of two.  Weights come from expectation
maximisation on held-out counts: one part in ``PARTS`` of the training documents is
deleted from all counts, and its tokens are explained by the rest.  The final scores use
all training counts.

Counting.  Documents are dealt by hash into chunks of about ``CHUNK_BYTES`` of text
(deleted documents into chunks of their own, so that a chunk's counts are deleted as a
whole).  A chunk sends its distinct n-grams, packed as sorted hash differences, to buckets
of the hash range, which add up counts and answer each chunk in the order it asked.  A
chunk therefore holds just the counts it needs, nothing is sent to all tasks, and a
frequent n-gram is one entry a chunk.  The answers are written to the checkpoint folder;
learning reads those of the deleted chunks, and scoring all.

Defined cases: null texts are empty (one end token); a null doc_id counts as the empty
string for the fold; rows count one by one, repeated ones too; without training or
held-out documents the weights are ``NO_DATA``; columns besides doc_id and text are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textkern as tk
from gridloom.llm.scratch import saved, tidy
from gridloom.llm.toxicity import fold

PARTS = 10
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 6 << 20
DELETED = 1
EM_ROUNDS = 60
NO_DATA = (0.5, 0.4, 0.1)
#: Steps an octave that probabilities are rounded to for learning alone.
GRID = 8

END, START = np.uint64(0xE5D0_0000_0000_0002), np.uint64(0x57A7_0000_0000_0004)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PAIR = np.uint64(1)


class Tokens:
    """Tokens of some texts: hash, context and row of each; a text's end comes last."""

    def __init__(self, column: pa.Array) -> None:
        data, off = tk.buffers(column)
        rows = len(off) - 1
        hashes, counts = [], []
        for lo, hi in tk.slices(off):
            w = tk.Words(_LOWER[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo])
            hashes.append(w.hashes())
            counts.append(w.count)
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.n = (np.concatenate(counts) if counts else np.zeros(0, np.int64)) + 1
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        self.row = np.repeat(np.arange(rows), self.n)
        self.token = np.empty(len(self.row), np.uint64)
        ends = np.zeros(len(self.row), bool)
        ends[self.first[1:] - 1] = True
        self.token[~ends] = words
        self.token[ends] = END
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.first[:-1]] = START
        one = ~_PAIR
        self.alone = self.token & one
        self.pair = tk.mix(self.context * np.uint64(0x9E3779B97F4A7C15) + tk.mix(self.token)) | _PAIR


def _packed(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte tells."""
    most = int(values.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + pa.compress(values.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[1:], n * raw[0], codec="zstd", asbytes=True), f"<u{raw[0]}").astype(np.int64)


def _pack_keys(keys: np.ndarray, base: int) -> bytes:
    """Sorted keys as differences, byte planes that are zero throughout left out."""
    d = np.diff(keys, prepend=np.uint64(base))
    planes = d.view(np.uint8).reshape(-1, 8).T
    top = 8
    while top > 1 and not planes[top - 1].any():
        top -= 1
    return bytes([top]) + np.ascontiguousarray(planes[:top]).tobytes()


def _unpack_keys(raw: bytes, base: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, : raw[0]] = planes.T
    return np.cumsum(d.reshape(-1).view(np.uint64), dtype=np.uint64) + np.uint64(base)


def _bases(buckets: int) -> list[int]:
    return [(i << 64) // buckets for i in range(buckets)]


def _ask(buckets: int):
    """n-grams of a chunk and their counts, by bucket."""

    def run(table: pa.Table) -> pa.Table:
        t = Tokens(table["text"])
        learned = table["part"].to_numpy() != 0
        keys = np.concatenate((t.alone, t.pair))
        weigh = np.tile(np.repeat(learned, t.n), 2)
        # the number of training texts is the count of the start context
        keys, at = np.unique(np.append(keys, START & ~_PAIR), return_inverse=True)
        count = np.bincount(at[:-1][weigh], minlength=len(keys))
        count[at[-1]] += int(learned.sum())
        bases = _bases(buckets)
        cuts = np.searchsorted(keys, np.array(bases, np.uint64)).tolist() + [len(keys)]
        rows = [(b, _pack_keys(keys[lo:hi], bases[b]), _packed(count[lo:hi])) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
        chunk = table["chunk"][0].as_py()
        return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _answer(buckets: int, deleted_chunks: int):
    """Adds up a bucket and answers its chunks; one more row holds the bucket's totals."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        bucket = table["bucket"][0].as_py()
        base = _bases(buckets)[bucket]
        keys = [_unpack_keys(x.as_py(), base) for x in table["keys"]]
        counts = [_unpacked(x.as_py(), len(k)) for x, k in zip(table["counts"], keys, strict=True)]
        chunks = table["chunk"].to_pylist()
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)
        gone = np.concatenate([c if k < deleted_chunks else np.zeros_like(c) for k, c in zip(chunks, counts, strict=True)])
        deleted = np.bincount(at, gone, len(every)).astype(np.int64)
        alone = (every & _PAIR == 0) & (every != START & ~_PAIR)
        rows, lo = [], 0
        for chunk, k in zip(chunks, keys, strict=True):
            mine = at[lo : lo + len(k)]
            lo += len(k)
            # only deleted chunks are read for learning
            rows.append((chunk, len(k), _packed(total[mine]), _packed(deleted[mine]) if chunk < deleted_chunks else b""))
        stats = [int(total[alone].sum()), int((total[alone] > 0).sum()), int(deleted[alone].sum())]
        n = len(rows)
        return pa.table(
            {
                "chunk": pa.array([r[0] for r in rows] + [-1], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int64()), "size": pa.array([r[1] for r in rows] + [0], pa.int64()),
                "total": pa.array([r[2] for r in rows] + [b""], pa.binary()), "deleted": pa.array([r[3] for r in rows] + [b""], pa.binary()), "stats": pa.array([None] * n + [stats], pa.list_(pa.int64())),
            }
        )

    return run


def _counts(t: Tokens, answers: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each token's pair, of its context and of itself."""
    answers = answers.sort_by("bucket")
    found = np.concatenate([_unpacked(x.as_py(), n) for x, n in zip(answers[column], answers["size"].to_pylist(), strict=True)])
    keys, at = np.unique(np.concatenate((t.alone, t.pair, [START & ~_PAIR])), return_inverse=True)
    assert len(keys) == len(found)
    n = len(t.token)
    alone, pair = found[at[:n]], found[at[n : 2 * n]]
    context = np.empty_like(alone)
    context[1:] = alone[:-1]
    context[t.first[:-1]] = found[at[-1]]
    return pair, context, alone


def frequency_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the power of two below the count."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def _evidence(n: int, n_deleted: int):
    """Held-out tokens by bucket and rounded estimates."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ("bucket", "p2", "p1")
        if not docs.num_rows or not answers.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in (*names, "tokens")})
        t = Tokens(docs["text"])
        rest = [a - d for a, d in zip(_counts(t, answers, "total"), _counts(t, answers, "deleted"), strict=True)]
        pair, context, alone = rest
        step = lambda p: np.where(p > 0, np.rint(-np.log2(np.maximum(p, 1e-300)) * GRID), -1).astype(np.int64)
        p2 = step(pair / np.maximum(context, 1))
        p1 = step(alone / max(1, n - n_deleted))
        cell, many = np.unique(np.stack((frequency_bucket(context), p2, p1)), axis=1, return_counts=True)
        return pa.table(dict(zip(names, cell, strict=True)) | {"tokens": many})

    return run


def learn(cells: np.ndarray, vocabulary: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (pair, alone, uniform) by bucket, from rows bucket, p2, p1, tokens."""
    out = np.tile(np.array(NO_DATA), (66, 1))
    if not len(cells):
        return out
    p = np.stack([np.where(cells[:, k] >= 0, 2.0 ** (-cells[:, k] / GRID), 0.0) for k in (1, 2)] + [np.full(len(cells), 1 / (vocabulary + 1))], 1)

    def em(mine: np.ndarray) -> np.ndarray:
        weight = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = weight * p[mine]
            share *= (cells[mine, 3] / share.sum(1))[:, None]
            weight = np.maximum(share.sum(0) / share.sum(), 1e-6)
            weight /= weight.sum()
        return weight

    out[:] = em(np.ones(len(cells), bool))
    for b in np.unique(cells[:, 0]).tolist():
        out[b] = em(cells[:, 0] == b)
    return out


def _score(weights: np.ndarray, n: int, vocabulary: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        t = Tokens(docs["text"])
        pair, context, alone = _counts(t, answers, "total")
        w = weights[frequency_bucket(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * alone / max(1, n) + w[:, 2] / (vocabulary + 1)
        base = np.log10((alone + 0.1) / (n + 0.1 * (vocabulary + 1)))
        rows = docs.num_rows
        known = np.bincount(t.row, alone > 0, rows).astype(np.int64)
        return pa.table(
            {
                "doc_id": docs["doc_id"], "held_out": pa.array(docs["part"].to_numpy() == 0), "n_tokens": pa.array(t.n.astype(np.int64)), "n_known": pa.array(known), "train_tokens": pa.array(np.full(rows, n, np.int64)),
                "base_score": pa.array(np.bincount(t.row, base, rows)), "score": pa.array(np.bincount(t.row, np.log10(p), rows)),
            }
        )

    return run


def _chunked(docs: DataFrame, deleted_chunks: int, other_chunks: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(parts=PARTS).cast("int").alias("part"), text.alias("text"))
    key = F.xxhash64("doc_id", "text")
    return rows.withColumn("chunk", F.when(F.col("part") == DELETED, F.pmod(key, F.lit(deleted_chunks))).otherwise(deleted_chunks + F.pmod(key, F.lit(other_chunks))))


def scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    other = max(1, -(-size // chunk_bytes))
    deleted, buckets = max(1, -(-other // PARTS)), max(1, -(-size // bucket_bytes))
    with tidy(spark):
        chunked = _chunked(docs, deleted, other)
        asked = chunked.groupBy("chunk").applyInArrow(_ask(buckets), "chunk long, bucket long, keys binary, counts binary")
        answered = asked.groupBy("bucket").applyInArrow(_answer(buckets, deleted), "chunk long, bucket long, size long, total binary, deleted binary, stats array<long>")
        answers = saved(answered)
        stats = answers.where("chunk < 0").agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(3))).first()
        n, vocabulary, n_deleted = (int(x) for x in stats)
        held = chunked.where(F.col("part") == DELETED).groupBy("chunk")
        seen = held.cogroup(answers.where((F.col("chunk") >= 0) & (F.col("chunk") < deleted)).groupBy("chunk")).applyInArrow(_evidence(n, n_deleted), "bucket long, p2 long, p1 long, tokens long")
        cells = seen.groupBy("bucket", "p2", "p1").agg(F.sum("tokens").alias("tokens")).orderBy("bucket", "p2", "p1").toPandas()  # bounded by the grid
    weights = learn(cells.to_numpy(np.int64), vocabulary)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunked.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk")).applyInArrow(_score(weights, n, vocabulary), out)
