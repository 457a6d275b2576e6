"""Phrases that stand together more often than their parts: suffix pointers, multikey quicksort.

1. A text is cut into pieces, a piece into words.  Every word starts a suffix, of up to
   ``WORDS`` words and no longer than its piece.  A task sorts the suffixes of about
   ``CHUNK`` bytes of text and sums up equal ones, so that only distinct ones travel.
2. Suffixes are routed by language and leading words: bounds taken from a sample cut their
   byte order into ranges of about ``RANGE`` suffixes.  A frequent word, or pair of words,
   is cut by the words after it, and thus never meets in one task.
3. In each range the pointers of its suffixes go through a three-way quicksort on one
   word after the other, the language first: the pointers equal to the pivot are one
   phrase, their weights its count, and they are sorted on by their next word.  Parts that
   weigh less than ``LEAST`` are abandoned.  A phrase that a bound may divide is never
   abandoned and is put out by each range that holds some of it; one sum over all ranges
   gives the counts.
4. Each cut of a phrase looks up the counts of both parts, which are at least as frequent
   as the phrase and so were counted too.  Scores are exact, in decimals of 38 digits.

The sample decides only where ranges begin, never what is counted.  Rows that travel are
at most one a suffix, and far fewer while ranges are fewer than a chunk's suffixes.

Defined cases: null, empty and blank texts hold no words; a null language is ``und``; rows
count each for themselves, whatever their doc_id and however often repeated; a text is cut
into no parts, however long; an empty table gives an empty result; columns besides text
and lang are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import textkern as tk
from gridloom.llm.scratch import Scratch

WORDS, LEAST, COVER, TOP = 3, 10, 50, 2000
CHUNK, RANGE = 4 << 20, 1 << 19
#: The sample that bounds are taken from: about so many texts, so many suffixes of each,
#: so many bytes of each suffix.
SAMPLE, SAMPLE_KEYS, KEY_BYTES = 5000, 32, 64
#: Groups of a language that are ranked before it is ranked as a whole.
RANK_GROUPS = 256

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\v\f\r")] = True
_IS_WORD = ~_BREAK
_IS_WORD[list(b" \t")] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLOB = "range int, lang string, size long, n long, text binary, counts binary"
_COUNT = "lang string, words int, phrase string, f long"


class Suffixes:
    """Words of lower-cased texts as codes in ``kinds``, codes in order of the words' bytes
    with a blank behind each; ``left``: words that the piece has from each word on."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        data = _LOWER[data]
        w = tk.Words(data, off, _IS_WORD)
        breaks = np.cumsum(_BREAK[data], dtype=np.int64)
        n = len(w.start)
        part = breaks[w.start] if n else np.zeros(0, np.int64)
        last = np.flatnonzero(np.append((part[1:] != part[:-1]) | (w.row[1:] != w.row[:-1]), True)) if n else np.zeros(0, np.int64)
        self.row, self.left = w.row, last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1
        ends = np.concatenate(([0], np.cumsum(w.end - w.start)))
        words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data[_IS_WORD[data]])]).dictionary_encode()
        self.kinds, self.code = ordered(words.dictionary, words.indices.to_numpy())

    def sorted(self, which: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct suffixes at the given words in order, as rows of codes (-1: none), and
        how often each stands."""
        codes = [np.where(self.left[which] > d, self.code[np.minimum(which + d, len(self.code) - 1)], -1) for d in range(depth)]
        base = len(self.kinds) + 1
        key = codes[-1] + 1
        for c in codes[-2::-1]:
            if len(key) and int(key.max()) >= (1 << 62) // base:
                key = np.unique(key, return_inverse=True)[1]
            key = (c + 1) * (int(key.max(initial=0)) + 1) + key
        _, at, count = np.unique(key, return_index=True, return_counts=True)
        return np.stack([c[at] for c in codes], 1), count


def ordered(kinds: pa.Array, code: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words by their bytes with a blank behind, codes likewise."""
    order = pc.array_sort_indices(pc.binary_join_element_wise(kinds, pa.scalar(b"", kinds.type), pa.scalar(b" ", kinds.type)))
    rank = np.empty(len(kinds), np.int64)
    rank[order.to_numpy()] = np.arange(len(kinds))
    return kinds.take(order), rank[code]


def phrases(kinds: pa.Array, codes: np.ndarray) -> pa.Array:
    """Rows of codes as text, words joined by one blank."""
    empty = pa.scalar(b"", kinds.type)
    later = pc.binary_join_element_wise(empty, kinds, pa.scalar(b" ", kinds.type))
    none = pa.array([b""], kinds.type)
    first, later = (pa.concat_arrays([k, none]) for k in (kinds, later))
    words = [(later if d else first).take(pa.array(np.where(c < 0, len(kinds), c))) for d, c in enumerate(codes.T)]
    return pc.binary_join_element_wise(*words, empty)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[Suffixes, pa.Array]]:
    for b in batches:
        data, off = tk.buffers(b.column("text"))
        for lo, hi in tk.slices(off, size):
            yield Suffixes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), b.column("lang").slice(lo, hi - lo)


def _sample(depth: int):
    """(key, weight): leading bytes of evenly spaced suffixes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, langs in _chunks(batches, tk.SLICE_BYTES):
            words = np.bincount(s.row, minlength=len(langs))
            take = np.minimum(words, SAMPLE_KEYS)
            first = np.concatenate(([0], np.cumsum(words)[:-1]))
            row = np.repeat(np.arange(len(langs)), take)
            at = first[row] + (tk.expand(np.zeros(len(take), np.int64), take) * words[row]) // np.maximum(take[row], 1)
            codes = np.stack([np.where(s.left[at] > d, s.code[np.minimum(at + d, len(s.code) - 1)], -1) for d in range(depth)], 1)
            keys = [(lang.encode() + b"\n" + text + b" ")[:KEY_BYTES] for lang, text in zip(langs.take(pa.array(row)).to_pylist(), phrases(s.kinds, codes).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(words[row] / take[row], pa.float64())], names=["key", "weight"])

    return run


def bounds(docs: DataFrame, depth: int, size: int) -> list[bytes]:
    """Keys that cut the suffixes of all texts into ranges of about ``size``."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    got = sorted((bytes(r.key), r.weight) for r in docs.sample(share, seed=1).mapInArrow(_sample(depth), "key binary, weight double").collect())
    if not got:
        return []
    upto = np.cumsum([w for _, w in got])
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(upto[-1] / share / size) + 1)
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return sorted({got[min(i, len(got) - 1)][0] for i in at})


def _route(depth: int, cuts: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, langs in _chunks(batches, CHUNK):
            langs = langs.dictionary_encode()
            of = langs.indices.to_numpy()[s.row]
            by_lang = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[by_lang], np.arange(len(langs.dictionary) + 1))
            out: list[tuple] = []
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                which = by_lang[edges[k] : edges[k + 1]]
                if not len(which):
                    continue
                codes, count = s.sorted(which, depth)
                text = pc.binary_join_element_wise(phrases(s.kinds, codes), pa.scalar(b"", s.kinds.type), pa.scalar(b"\n", s.kinds.type))
                _, off, data = text.buffers()
                off, n = np.frombuffer(off, np.int64)[: len(text) + 1], len(text)
                raw = memoryview(data)
                head = lang.encode() + b"\n"

                def key(i: int) -> bytes:
                    return head + bytes(raw[off[i] : off[i + 1] - 1]) + b" "

                first, last = bisect_right(cuts, key(0)), bisect_right(cuts, key(n - 1))
                at = [0, *(bisect_left(range(n), c, key=key) for c in cuts[first:last]), n]
                for r, lo, hi in zip(range(first, last + 1), at[:-1], at[1:], strict=True):
                    if lo < hi:
                        size = int(off[hi] - off[lo])
                        out.append((r, lang, size, hi - lo, pa.compress(raw[off[lo] : off[hi]], "zstd", asbytes=True), pa.compress(count[lo:hi].astype("<u4").tobytes(), "zstd", asbytes=True)))
            if out:
                kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["range", "lang", "size", "n", "text", "counts"])

    return run


def multikey_quicksort(symbols: np.ndarray, weight: np.ndarray, least: int, divided: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, a pointer to one member, and weight of all groups of strings with equal first
    symbols that weigh ``least`` or more.

    symbols: depth x strings, -1 past the end of a string.  divided, of the same shape: the
    group of the string at this depth has members elsewhere, so that its weight here says
    nothing.  All parts of one round are sorted side by side: each takes the median of
    three of its symbols as pivot and is cut into less, equal and greater; the equal one
    is a group, and goes on with the next symbol."""
    depth, n = symbols.shape
    flat, other = symbols.ravel(), None if divided is None or not divided.any() else divided.ravel()
    order = np.arange(n)
    start, stop, level = np.array([0] if n else [], np.int64), np.array([n] if n else [], np.int64), np.zeros(1 if n else 0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(start):
        size = stop - start
        first = np.cumsum(size) - size
        part = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(part)) + np.repeat(start - first, size)
        member = order[at]
        cell = level[part] * n + member if len(start) > 1 or level[0] else member
        s = flat[cell]
        a, b, c = s[first], s[first + size // 2], s[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        p = pivot[part]
        side = (s >= p).astype(np.int8) + (s > p)
        key = part * 3 + side
        many = np.bincount(key, minlength=3 * len(start)).reshape(-1, 3)
        heavy = np.bincount(key, weight[member], 3 * len(start)).reshape(-1, 3)
        claim = heavy if other is None else heavy + least * np.bincount(key, other[cell], 3 * len(start)).reshape(-1, 3)
        base = start[:, None] + np.cumsum(many, 1) - many
        for k in range(3):
            mine = np.flatnonzero(side == k)
            before = np.cumsum(many[:, k]) - many[:, k]
            order[np.arange(len(mine)) + (base[:, k] - before)[part[mine]]] = member[mine]
        keep = (many > 0) & (claim >= least)
        group = np.flatnonzero(keep[:, 1] & (pivot >= 0))
        found.append((level[group], order[base[group, 1]], heavy[group, 1]))
        deeper = group[level[group] + 1 < depth]
        sides = [np.flatnonzero(keep[:, k]) for k in (0, 2)]
        start, stop, level = (
            np.concatenate((base[sides[0], 0], base[sides[1], 2], base[deeper, 1])),
            np.concatenate((base[sides[0], 0] + many[sides[0], 0], base[sides[1], 2] + many[sides[1], 2], base[deeper, 1] + many[deeper, 1])),
            np.concatenate((level[sides[0]], level[sides[1]], level[deeper] + 1)),
        )
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lv, who, heavy = (np.concatenate(x) for x in zip(*found, strict=True))
    return lv, who, heavy.astype(np.int64)


def _count(depth: int, least: int, cuts: list[bytes]):
    """Counts of the phrases of each range; rows come range by range."""

    def counted(r: int, blobs: list[tuple]) -> pa.RecordBatch:
        langs = sorted({b[0] for b in blobs})
        of = np.repeat([langs.index(b[0]) for b in blobs], [b[2] for b in blobs])
        weight = np.concatenate([np.frombuffer(pa.decompress(b[4], 4 * b[2], "zstd"), "<u4") for b in blobs]).astype(np.float64)
        data = np.frombuffer(b"".join(pa.decompress(b[3], b[1], "zstd", asbytes=True) for b in blobs), np.uint8)
        end = np.flatnonzero((data == 32) | (data == 10))
        closes = data[end] == 10
        which = np.cumsum(closes) - closes
        first = np.flatnonzero(np.concatenate(([True], closes[:-1])))
        place = np.arange(len(end)) - first[which]
        size = end - np.concatenate(([-1], end[:-1])) - 1
        offsets = np.concatenate(([0], np.cumsum(size)))
        words = pa.Array.from_buffers(pa.large_binary(), len(end), [None, pa.py_buffer(offsets), pa.py_buffer(data[(data != 32) & (data != 10)])]).dictionary_encode()
        kinds, code = ordered(words.dictionary, words.indices.to_numpy())
        symbols = np.full((depth + 1, len(of)), -1, np.int32)
        symbols[0] = of
        symbols[place + 1, which] = code
        divided = np.zeros(symbols.shape, bool)
        for cut in cuts[max(r - 1, 0) : r + 1] if r else cuts[:1]:
            for k, lang in enumerate(langs):
                head = lang.encode() + b"\n"
                if cut.startswith(head):
                    on, rest = symbols[0] == k, cut[len(head) :]
                    divided[0] |= on
                    for d in range(1, depth + 1):
                        word, blank, rest = rest.partition(b" ")
                        at = pc.index(kinds, pa.scalar(word, kinds.type)).as_py()
                        if not blank or at < 0:
                            break
                        on = on & (symbols[d] == at)
                        divided[d] |= on
        level, who, f = multikey_quicksort(symbols, weight, least, divided)
        codes = np.where(np.arange(depth) < level[:, None], symbols[1:, who].T, -1)
        text = phrases(kinds, codes).cast(pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(symbols[0, who])), pa.array(level.astype(np.int32)), text, pa.array(f)], names=["lang", "words", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = -1, []
        for b in batches:
            for r, *blob in zip(*(b.column(c).to_pylist() for c in ("range", "lang", "size", "n", "text", "counts")), strict=True):
                if r != now:
                    if blobs:
                        yield counted(now, blobs)
                    now, blobs = r, []
                blobs.append(blob)
        if blobs:
            yield counted(now, blobs)

    return run


def phrase_counts(docs: DataFrame, words: int = WORDS, least: int = LEAST, size: int = RANGE) -> DataFrame:
    """lang, words, phrase, f of every phrase of up to ``words`` words that stands ``least``
    times or more; for 0 words, f is the number of all words of the language."""
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).where("text is not null")
    cuts = bounds(texts, words, size)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = texts.mapInArrow(_route(words, cuts), _BLOB).repartitionById(tasks, (F.col("range").cast("long") * tasks / (len(cuts) + 1)).cast("int")).sortWithinPartitions("range")
    counts = routed.mapInArrow(_count(words, least, cuts), _COUNT).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return counts.where((F.col("f") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, cover: int = COVER, top: int = TOP, size: int = RANGE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``words`` words of
    each language."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.save(phrase_counts(docs, words, least, size), "counts")
    long = counts.where("words >= 2").select("lang", "words", "phrase", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cut = long.select("lang", "words", "phrase", "w", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words")).alias("rest"))
    for name, of in (("l", "first"), ("r", "rest")):
        cut = cut.join(counts.where("words >= 1").select("lang", F.col("phrase").alias(of), F.col("f").alias(name)), ["lang", of])
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    cut = cut.withColumn("score", F.expr(f"cast((1000000 * ({whole('a')} * {whole('a')})) div ({whole('l')} * {whole('r')}) as long)"))
    scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("low"))
    lengths = F.sequence(F.lit(2), F.col("words") - 1)
    inner = long.where("words > 2").select("lang", "a", "words", "w", F.explode(lengths).alias("n")).select("lang", "a", "w", "n", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)).alias("at"))
    inner = inner.groupBy("lang", part(F.col("at"), F.col("n")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {cover} * a").select("lang", "phrase", "a", "low.*")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
    for keys in ((F.col("lang"), group), (F.col("lang"),)):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return kept.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
