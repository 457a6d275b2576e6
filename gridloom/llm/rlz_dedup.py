"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against the text that starts earlier (smaller id, or the same
document further left).  The reference text is dealt into indexed blocks by *anchors*: the
least hash among the ``SEED``-word grams of a window of ``window`` words.  Both places of a
repeated window pick the same anchor, so a document meets every block that can hold a
factor of ``window`` words of it, as the segment of its words that picks this anchor.  An
anchor that occurs once has nothing to refer to; its segment does not travel.

A block indexes its segments by a suffix array over words.  Each segment is parsed
greedily: the longest factor that also starts earlier is taken, then the next one from its
end, or from the next word if there is none.  Factors of ``window`` words or more are
duplicate spans.  Windows that cross the end of a factor, which a parse alone would miss,
are checked at the boundary against their own longest earlier factor.  Words are compared
by their bytes, not by hashes.

A frequent anchor is split into sub-blocks of about ``HOT`` segments, dealt by the hash of
the whole window, so that a phrase that stands in most documents fills no single task; and
a task sends equal segments once.

Defined cases: a null text has no words; a null doc_id comes after all others; rows with
one doc_id are told apart by a digest of their text, and of identical rows none counts as
earlier; very long texts are parsed whole; an empty table gives an empty result; columns
besides doc_id and text, of any name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textkern as tk
from gridloom.llm.scratch import Scratch, tidy

WINDOW = 20
#: Words of an anchor gram.  Shorter ones gather more windows under one anchor.
SEED = 4
HOT = 20_000
NO_ID = (1 << 63) - 1
#: Words up to which suffixes are put in order; longer factors are followed on from there.
LONG = 64
#: Words that a task parses at once.
_PARSED = 400_000

_SEGMENT = "anchor long, sub int, id long, copy long, start int, words string, ref_id long, ref_start int, n_words int"
_FACTOR = "id long, copy long, start int, n_words int, ref_id long, ref_start int"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _cuts(*same: np.ndarray) -> np.ndarray:
    """Starts of the runs in which each given comparison with the row before holds."""
    return np.concatenate(([0], np.flatnonzero(~np.logical_and.reduce(same)) + 1))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("copy"), F.col("doc_id"), text.alias("text"))


class _Anchors:
    """Anchor of each window of some texts, and the segments of windows with one anchor."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int) -> None:
        self.words = w = tk.Words(data, off)
        seed = min(SEED, window)
        n = len(w.start) - window + 1
        self.at = np.flatnonzero(w.row[:n] == w.row[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if not len(self.at):
            self.cut = self.size = self.anchor = self.times = self.at
            return
        self.hash = w.hashes()
        gram = tk.signed(tk.gram_hashes(self.hash, seed))
        every = tk.signed(tk.sliding_min(gram.view(np.uint64), window - seed + 1))[self.at]
        self.cut = _cuts(self.at[1:] == self.at[:-1] + 1, w.row[self.at][1:] == w.row[self.at][:-1], every[1:] == every[:-1])
        self.size = np.diff(np.append(self.cut, len(self.at)))
        self.anchor = every[self.cut]
        # a segment that holds its anchor twice can repeat itself
        n = self.size + window - seed
        hits = gram[tk.expand(self.at[self.cut], n)] == np.repeat(self.anchor, n)
        self.times = np.minimum(np.add.reduceat(hits, np.concatenate(([0], np.cumsum(n)[:-1])), dtype=np.int64), 2)


def _places(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tk.buffers(b.column("text"))
            ids, copies = b.column("id").to_numpy(), b.column("copy").to_numpy()
            for lo, hi in tk.slices(off):
                a = _Anchors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], window)
                row = lo + a.words.row[a.at[a.cut]] if len(a.at) else a.at
                yield pa.RecordBatch.from_arrays([pa.array(a.anchor.astype(np.int64)), pa.array(ids[row]), pa.array(copies[row]), pa.array(a.times.astype(np.int32))], names=["anchor", "id", "copy", "times"])

    return run


def _segments(window: int):
    """Segments whose anchors occur elsewhere too; of equal ones in a batch the first, and a
    factor for each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_SEGMENT)
        for b in batches:
            data, off = tk.buffers(b.column("text"))
            ids, copies = b.column("id").to_numpy(), b.column("copy").to_numpy()
            asked = b.column("anchors")
            asked = asked.fill_null(pa.scalar([], asked.type)) if asked.null_count else asked
            bound, flat = asked.offsets.to_numpy(), asked.flatten()
            anchor, cuts = flat.field("anchor").to_numpy(), flat.field("cuts").to_numpy()
            bound = bound - bound[0]
            for lo, hi in tk.slices(off):
                a = _Anchors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], window)
                mine = slice(bound[lo], bound[hi])
                if not len(a.at) or mine.start == mine.stop:
                    continue
                row_of = lambda row, x: tk.mix(row.astype(np.uint64) + tk.mix(x.view(np.uint64)))
                key = row_of(np.repeat(np.arange(hi - lo), np.diff(bound[lo : hi + 1])), np.ascontiguousarray(anchor[mine]))
                order = np.argsort(key)
                row = a.words.row[a.at[a.cut]]
                own = row_of(row, np.ascontiguousarray(a.anchor))
                place = np.minimum(np.searchsorted(key[order], own), len(key) - 1)
                taken = np.flatnonzero(key[order][place] == own)
                split = cuts[mine][order[place[taken]]]
                first, size, n_cuts = a.cut[taken], a.size[taken], split
                sub = np.zeros(len(taken), np.int64)
                if (split > 1).any():  # windows of a frequent anchor go one by one
                    many = np.where(split > 1, size, 1)
                    first, n_cuts = tk.expand(first, many), np.repeat(split, many)
                    size, taken = np.where(n_cuts > 1, 1, np.repeat(size, many)), np.repeat(taken, many)
                    win = tk.gram_hashes(a.hash, window)
                    sub = np.where(n_cuts > 1, (win[a.at[first]] % n_cuts.astype(np.uint64)).astype(np.int64), 0)
                w = a.words
                begin = a.at[first]
                end = begin + size + window - 1
                raw, row = w.data.tobytes(), w.row[begin]
                seen: dict[tuple, int] = {}
                text, lead = [], np.arange(len(begin))
                order = np.lexsort((w.place[begin], ids[lo + row]))
                plain = [None] * len(begin)
                for k in order.tolist():
                    x = raw[w.start[begin[k]] : w.end[end[k] - 1]]
                    if 9 in x or 10 in x or 11 in x or 12 in x or 13 in x or b"  " in x:
                        x = b" ".join(x.split())
                    lead[k] = seen.setdefault(x, k)
                    plain[k] = x
                f = lead
                i, s = ids[lo + row], w.place[begin]
                later = (i[f] < i) | ((i[f] == i) & (s[f] < s))
                # rows without words meet no block: dealt by place, or a passage of every document would be one task
                sub = np.where(later, -1 - (tk.mix(i.view(np.uint64) + tk.mix(s.astype(np.uint64))) >> np.uint64(44)).astype(np.int64), sub)
                text = pa.array([None if later[k] else x for k, x in enumerate(plain)], pa.binary()).cast(pa.string())
                no = lambda x: pa.array(x, mask=~later)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.anchor[taken].astype(np.int64)), pa.array(sub.astype(np.int32)), pa.array(i), pa.array(copies[lo + row]), pa.array(s.astype(np.int32)), text, no(i[f]), no(s[f].astype(np.int32)), no((end - begin).astype(np.int32))], schema=schema
                )

    return run


def _ranked(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order of the rows of the columns, equal ones for equal rows."""
    out = columns[0]
    for c in columns[1:]:
        low = int(c.min(initial=0))
        width = int(c.max(initial=0)) - low + 1
        if len(out) and (int(out.max()) - min(int(out.min()), 0) + 1) * width >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
        out = out * width + (c - low)
    return np.unique(out, return_inverse=True)[1]


def word_numbers(w: tk.Words) -> np.ndarray:
    """One number for each distinct word, told apart by bytes."""
    _, first, number = np.unique(w.hashes(), return_index=True, return_inverse=True)
    size = w.end - w.start
    same = size == size[first][number]
    padded = np.zeros(len(w.data) + 16, np.uint8)
    padded[: len(w.data)] = w.data
    eight = np.ndarray((len(w.data) + 9,), "<u8", padded, strides=(1,))
    left, at, ref = np.arange(len(size)), w.start, w.start[first][number]
    step = 0
    while len(left):
        rest = np.minimum(size[left] - step, 8)
        same[left] &= ((eight[at[left] + step] ^ eight[ref[left] + step]) & tk._TAIL[rest]) == 0
        step += 8
        left = left[(size[left] > step) & same[left]]
    if not same.all():  # two words with one hash
        known: dict[bytes, int] = {}
        raw = w.data.tobytes()
        number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)], np.int64)
    return number


def _nearest_smaller(x: np.ndarray) -> np.ndarray:
    """Nearest place to the left with a smaller value; -1 if there is none."""
    out = np.arange(len(x)) - 1
    open_ = np.flatnonzero(out >= 0)
    while len(open_):
        open_ = open_[x[out[open_]] >= x[open_]]
        out[open_] = out[out[open_]]
        open_ = open_[out[open_] >= 0]
    return out


class Index:
    """Suffix array over the words of segments, block by block.  ``longest`` is the length of
    the longest factor that starts at a word and also starts at an earlier place of its
    block, ``source`` such a place."""

    def __init__(self, number: np.ndarray, block: np.ndarray, order: np.ndarray, end: np.ndarray) -> None:
        """number, block, rank of its place, and end of its segment of each word."""
        n = len(number)
        self.end = end
        ranks, width = [_ranked(block, number)], 1
        room = end - np.arange(n)
        while width < min(room.max(initial=1), LONG):
            r = ranks[-1]
            after = np.full(n, -1)
            fits = np.flatnonzero(room > width)
            after[fits] = r[fits + width]
            ranks.append(_ranked(r, after))
            width *= 2
        self.ranks = ranks
        suffix = np.lexsort((order, ranks[-1]))
        x = order[suffix]
        self.longest, self.source = np.zeros(n, np.int64), np.full(n, -1)
        for near in (_nearest_smaller(x), n - 1 - _nearest_smaller(x[::-1])[::-1]):
            ok = np.flatnonzero((near >= 0) & (near < n))
            p, q = suffix[ok], suffix[near[ok]]
            got = self._common(p, q)
            more = got > self.longest[p]
            self.longest[p[more]], self.source[p[more]] = got[more], q[more]

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Words that two places have in common from there on, within their segments."""
        length = np.zeros(len(p), np.int64)
        room = np.minimum(self.end[p] - p, self.end[q] - q)

        def extend(k: int, among: np.ndarray) -> np.ndarray:
            among = among[length[among] + (1 << k) <= room[among]]
            r, n = self.ranks[k], length[among]
            among = among[r[p[among] + n] == r[q[among] + n]]
            length[among] += 1 << k
            return among

        more = np.arange(len(p))
        while len(more):  # more than once for factors of several times LONG words
            more = extend(len(self.ranks) - 1, more)
        for k in range(len(self.ranks) - 2, -1, -1):
            extend(k, np.arange(len(p)))
        return length

    def parse(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the factors of the segments that begin at first; words without
        an earlier place are factors of one word."""
        out, at, end = [first[:0]], first, self.end[first]
        while len(at):
            out.append(at)
            at = at + np.maximum(self.longest[at], 1)
            go = at < end
            at, end = at[go], end[go]
        start = np.sort(np.concatenate(out))
        return start, start + np.maximum(self.longest[start], 1)


def _parse(window: int):
    """Rows come block by block, in order of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_FACTOR)
        held: list[pa.Table] = []
        size, known = 0, 0  # known: leading segments that were parsed before

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, known
            t = pa.concat_tables(held).combine_chunks()
            w = tk.Words(*tk.buffers(t["words"]))
            seg = w.row
            anchor, sub, ids, copies, start = (t[c].to_numpy() for c in ("anchor", "sub", "id", "copy", "start"))
            block = np.zeros(t.num_rows, np.int64)
            block[1:] = np.cumsum((anchor[1:] != anchor[:-1]) | (sub[1:] != sub[:-1]))
            place = start[seg].astype(np.int64) + w.place
            order = _ranked(np.unique(ids, return_inverse=True)[1][seg], place)
            first = w.first[:-1]
            index = Index(word_numbers(w), block[seg], order, w.first[1:][seg])
            begin, end = index.parse(first[known:])
            long_ = np.flatnonzero(end - begin >= window)
            # windows that cross the end of their factor
            stop = np.zeros(len(seg) + 1, np.int64)
            stop[begin] = end
            stop = np.maximum.accumulate(stop)[:-1]
            p = np.arange(len(seg))
            cross = np.flatnonzero((p >= first[known] if known < len(first) else np.zeros(len(p), bool)) & (p + window > stop) & (index.longest >= window))
            if len(long_):
                a = begin[long_]
                q = index.source[a]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[seg[a]], copies[seg[a]], place[a].astype(np.int32), (end - begin)[long_].astype(np.int32), ids[seg[q]], place[q].astype(np.int32))], schema=schema)
            if len(cross):
                q = index.source[cross]
                cut = _cuts(cross[1:] == cross[:-1] + 1, seg[cross][1:] == seg[cross][:-1], seg[q][1:] == seg[q][:-1], q[1:] == q[:-1] + 1)
                n = np.diff(np.append(cut, len(cross))) + window - 1
                a, q = cross[cut], q[cut]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[seg[a]], copies[seg[a]], place[a].astype(np.int32), n.astype(np.int32), ids[seg[q]], place[q].astype(np.int32))], schema=schema)
            # of the open block, segments that hold a window for the first time stay
            new = np.zeros(t.num_rows, bool)
            new[seg[(p + window <= index.end) & (index.longest < window)]] = True
            stay = np.flatnonzero(new & (block == block[-1]))
            held, size, known = [t.take(stay)], 0, len(stay)

        for b in batches:
            direct = b.column("words").is_null()
            if b.num_rows - direct.false_count:
                x = b.filter(direct)
                yield pa.RecordBatch.from_arrays([x.column(c) for c in ("id", "copy", "start", "n_words", "ref_id", "ref_start")], schema=schema)
                b = b.filter(pa.compute.invert(direct))
            if b.num_rows:
                held.append(pa.Table.from_batches([b.select(["anchor", "sub", "id", "copy", "start", "words"])]))
                size += b.column("words").get_total_buffer_size() // 6
                if size >= _PARSED:
                    yield from settle()
        if sum(x.num_rows for x in held) > known:
            yield from settle()

    return run


def factors(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """Duplicate factors: id, copy, start, n_words, ref_id, ref_start (places in words)."""
    scratch, keyed = Scratch(docs.sparkSession), _keyed(docs)
    places = keyed.select("id", "copy", "text").mapInArrow(_places(window), "anchor long, id long, copy long, times int")
    # a table of its own, as a plain side whose partner Spark can split
    repeated = scratch.save(places.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor", F.ceil(F.col("n") / hot).cast("int").alias("cuts")), "anchors")
    with tidy(docs.sparkSession):
        asked = places.select("anchor", "id", "copy").join(repeated, "anchor").groupBy("id", "copy").agg(F.collect_list(F.struct("anchor", "cuts")).alias("anchors"))
    # the same columns as in substring_dedup, so that texts are dealt by id once for both
    segments = keyed.join(asked, ["id", "copy"]).select("id", "copy", "doc_id", "text", "anchors").mapInArrow(_segments(window), _SEGMENT)
    blocks = segments.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub", "id", "start", "copy")
    return blocks.mapInArrow(_parse(window), _FACTOR)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, n_words, n_removed, digest = [], [], [], []
        for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
            words = text.as_py().encode().split()
            gone = np.zeros(len(words) + 1, np.int32)
            spans = spans.as_py() or []
            for s in spans:
                gone[s["start"]] += 1
                gone[min(s["start"] + s["n_words"], len(words))] -= 1
            left = words
            if spans:
                covered = np.cumsum(gone[:-1]) > 0
                left = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            out = b" ".join(left)
            kept.append(out.decode())
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            digest.append(hashlib.sha256(out).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "kept_text", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """One row a document: doc_id, kept_text, n_words, n_removed, kept_sha256."""
    spans = factors(docs, window, hot).groupBy("id", "copy").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    joined = _keyed(docs).join(spans, ["id", "copy"], "left").select("id", "copy", "doc_id", "text", "spans")
    return joined.mapInArrow(_keep, "doc_id long, kept_text string, n_words long, n_removed long, kept_sha256 string")
