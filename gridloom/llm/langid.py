"""Language identification, words first, with backoff to character n-grams.

A text's words, runs of Unicode letters in lower case, are scored by the log frequency
that each language gives them; a word no language knows falls back to its n-grams, the
longest order of which any is known, down to single letters.  Log likelihoods add up over
the text; ``score`` is the posterior of the best language under equal priors, with
evidence damped to one n-th root so that it stays informative.

Training counts words and n-grams over at most ``SAMPLE`` documents in order of a hash and
keeps all of them, in every language: the sample alone bounds the model.  Known words are
looked up by their hashes, and so are the n-grams of unknown words, a slice of texts at a
time.

Defined cases: ``und`` with score 0 for a null text or one without a letter, and for all
if nothing was learned; null languages teach nothing; ties go to the smaller language
name; a null doc_id counts as the empty string for the fold; very long texts are read
whole; an empty table gives an empty result; columns besides doc_id, text and lang, of any
name, are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textkern as tk
from gridloom.llm.toxicity import fold

SAMPLE = 10_000
ORDERS = (5, 4, 3, 2, 1)
ALPHA = 0.05


def words_of(text: str = "text"):
    """A text's words with one space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+", " "))


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = defaultdict(Counter)
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            words[lang].update(text.as_py().split())
    rows: list[tuple] = []
    for lang, seen in words.items():
        rows += [(lang, 0, w, n) for w, n in seen.items()]
        for order in ORDERS:
            c: Counter = Counter()
            for w, n in seen.items():
                for g in grams(w, order):
                    c[g] += n
            rows += [(lang, order, g, n) for g, n in c.items()]
    for lo in range(0, len(rows), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[lo : lo + 100_000], strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "n", "gram", "count"])


class Model:
    """Log frequency of words (order 0) and n-grams: what their languages add to the base
    that a language gives unknown ones, in one run of ``lang`` and ``gain`` each."""

    def __init__(self, langs: list[str], counts: dict[tuple[int, str], dict[int, int]], totals: dict[tuple[int, int], int], kinds: dict[tuple[int, int], int]) -> None:
        self.langs = langs
        # one number of kinds for all languages, so that a small vocabulary is no advantage
        most = {n: 1 + max((k for (m, _), k in kinds.items() if m == n), default=0) for n in (0, *ORDERS)}
        self.base = {n: np.array([np.log(ALPHA / (totals.get((n, i), 0) + ALPHA * most[n])) for i in range(len(langs))]) for n in (0, *ORDERS)}
        names: dict[int, list[str]] = {n: [] for n in (0, *ORDERS)}
        where: dict[int, list[int]] = {n: [] for n in (0, *ORDERS)}
        for k, (n, gram) in enumerate(counts):
            names[n].append(gram)
            where[n].append(k)
        self.start = np.cumsum([0, *map(len, counts.values())])
        size = int(self.start[-1])
        self.lang = np.fromiter((i for by in counts.values() for i in by), np.int32, size)
        self.gain = np.log((np.fromiter((c for by in counts.values() for c in by.values()), np.float64, size) + ALPHA) / ALPHA).astype(np.float32)
        self.key, self.entry = {}, {}
        for n in names:
            data, off = tk.buffers(pa.array(names[n], pa.string()))
            key = tk.hash_ranges(data, off[:-1], off[1:])
            order = np.argsort(key)
            self.key[n], self.entry[n] = key[order], np.array(where[n], np.int64)[order]

    def found(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known words or n-grams, and the entries of those."""
        key = self.key[n]
        if not len(key):
            return np.zeros(len(h), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(key, h), len(key) - 1)
        hit = key[at] == h
        return hit, self.entry[n][at[hit]]

    def sums(self, n: int, row: np.ndarray, entry: np.ndarray, rows: int) -> np.ndarray:
        """Log frequencies added up by row."""
        size = len(self.langs)
        count = self.start[entry + 1] - self.start[entry]
        each = tk.expand(self.start[entry], count)
        gains = np.bincount(np.repeat(row, count) * size + self.lang[each], self.gain[each], rows * size).reshape(rows, size)
        return gains + np.bincount(row, minlength=rows)[:, None] * self.base[n]

    def backoff(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of unknown words: the mean over their known n-grams of the longest order that has
        any."""
        words, size = len(start), end - start
        at = np.concatenate(([0], np.cumsum(size + 2)))
        padded = np.full(at[-1], ord(" "), np.uint8)
        padded[tk.expand(at[:-1] + 1, size)] = data[tk.expand(start, size)]
        letter = np.append(np.flatnonzero((padded & 0xC0) != 0x80), at[-1])  # where each begins
        first = np.searchsorted(letter, at)
        out, left = np.zeros((words, len(self.langs))), np.arange(words)
        for n in ORDERS:
            pad = 0 if n > 1 else 1  # single letters without the spaces around
            count = np.maximum(first[left + 1] - first[left] - 2 * pad - n + 1, 0)
            k = tk.expand(first[left] + pad, count)
            row = np.repeat(np.arange(len(left)), count)
            hit, entry = self.found(n, tk.hash_ranges(padded, letter[k], letter[k + n]))
            hits = np.bincount(row[hit], minlength=len(left))
            some = hits > 0
            out[left[some]] = (self.sums(n, row[hit], entry, len(left)) / np.maximum(hits, 1)[:, None])[some]
            left = left[~some]
            if not len(left):
                break
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of texts that ``words_of`` made."""
        data, off = tk.buffers(texts)
        names, scores = [], []
        for lo, hi in tk.slices(off):
            n, size = hi - lo, len(self.langs)
            w = tk.Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            total = np.zeros((n, max(1, size)))
            if size and len(w.start):
                h = w.hashes()
                hit, entry = self.found(0, h)
                total += self.sums(0, w.row[hit], entry, n)
                rest = np.flatnonzero(~hit)
                _, first, which = np.unique(h[rest], return_index=True, return_inverse=True)
                if len(rest):
                    table = self.backoff(w.data, w.start[rest[first]], w.end[rest[first]])
                    for j in range(size):
                        total[:, j] += np.bincount(w.row[rest], table[which, j], n)
                total /= np.sqrt(np.maximum(w.count, 1))[:, None]
            p = np.exp(total - total.max(1, keepdims=True))
            best = p.argmax(1)
            some = (w.count > 0) & (size > 0)
            names += [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            scores.append(np.where(some, p.max(1) / p.sum(1), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit(docs: DataFrame, sample: int = SAMPLE, parts: int = 5) -> Model:
    """Learns from documents outside fold 0 whose language is known."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(parts=parts) != 0))
    order = F.xxhash64("doc_id", "text")
    bound = known.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if bound is None:
        return Model([], {}, {}, {})
    taken = known.where(order <= F.lit(bound)).select("lang", words_of().alias("text"))
    sums = taken.mapInArrow(_count, "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    langs = sorted(r["lang"] for r in taken.select("lang").distinct().collect())
    at = {x: i for i, x in enumerate(langs)}
    counts: dict = defaultdict(dict)
    totals: dict = defaultdict(int)
    kinds: dict = defaultdict(int)
    for x in sums.select("lang", "n", "gram", "count").toArrow().to_batches():
        for lang, n, gram, c in zip(*(x.column(k).to_pylist() for k in ("lang", "n", "gram", "count")), strict=True):
            counts[n, gram][at[lang]] = c
            totals[n, at[lang]] += c
            kinds[n, at[lang]] += 1
    return Model(langs, dict(counts), dict(totals), dict(kinds))


def identify(docs: DataFrame, model: Model, parts: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            names, score = m.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(parts=parts) == 0).alias("held_out"), words_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, sample: int = SAMPLE, parts: int = 5) -> DataFrame:
    return identify(docs, fit(docs, sample, parts), parts)
