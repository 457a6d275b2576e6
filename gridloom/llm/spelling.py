"""Spelling variants: words one edit apart, found along a trie, and the form each leads to.

1. A task counts the words of some texts; one sum gives the words that count.
2. The trie of all words, spelled forwards and backwards, is a table of edges: for each
   node that has several words below it, its next letters (none: a word ends here), each
   with the number of words below, and that word itself where it is the only one.
3. The frontier is a table of states (word, position, node, edits), joined with the edges
   one level of the trie at a time.  A state without an edit follows its own letter, or
   replaces it by a later one, or leaves it out; a state with one follows its own letters.
   Where an edge has a single word below, the rest of both is compared at once and the
   state ends; so there are as many levels as two words share letters.
4. An edit in the second half of a word is found forwards, one in the first half
   backwards, so that words set out in the middle, where nodes have few edges; shorter
   words are found from longer ones, later letters from earlier ones, and all pairs are
   turned round afterwards.
5. Words above ``LONG`` letters, for which a trie would be deep, meet by hashes of
   themselves and of what leaving out each letter makes; their letters are compared after.

Defined cases: null and empty texts hold no words; a null doc_id is empty text in the
hash; equal runs under one doc_id are treated alike, rows that repeat count each; a run
whose only letter is deleted is no word; an empty table gives an empty result; columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textkern as tk
from gridloom.llm.scratch import Scratch

LETTERS, COUNT, SHARE = 5, 3, 97
#: How many times the count of a word its form must have.
FORM = 2
LONG = 32
CHUNK = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ASCII = np.zeros(256, bool)
_ASCII[ord("a") : ord("z") + 1] = True
_ASCII[ord("A") : ord("Z") + 1] = True
#: First byte of U+00C0 to U+00FF in UTF-8, whose second byte may be any.
_LATIN = 0xC3
_ONE = np.array([False, True] + [False] * 254)


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1).astype(np.uint32)
    return x


_CRC = _crc_table()
#: Bytes of a run that are hashed side by side with those of others.
_WIDE = 64


def crc32_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what gave ``state`` followed by the bytes of each range."""
    x = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    live = np.arange(len(start))
    for step in range(_WIDE):
        live = live[end[live] - start[live] > step]
        if not len(live):
            break
        x[live] = _CRC[(x[live] ^ data[start[live] + step]) & np.uint32(0xFF)] ^ (x[live] >> np.uint32(8))
    x ^= np.uint32(0xFFFFFFFF)
    raw = memoryview(data)
    for i in live[end[live] - start[live] > _WIDE].tolist():
        x[i] = zlib.crc32(raw[start[i] + _WIDE : end[i]], int(x[i]))
    return x


def _words(least: int, share: int):
    """word, n of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tk.buffers(b.column("text"))
            ids = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in b.column("doc_id").to_pylist()]
            for lo, hi in tk.slices(off, CHUNK):
                some = _LOWER[data[off[lo] : off[hi]]]
                latin = some == _LATIN
                mask = _ASCII[some] | latin
                mask[1:] |= latin[:-1]
                w = tk.Words(mask.view(np.uint8), off[lo : hi + 1] - off[lo], _ONE)
                ends = np.concatenate(([0], np.cumsum(latin)))
                size = w.end - w.start
                letters = size - (ends[w.end] - ends[w.start])
                crc = crc32_on(np.array(ids[lo:hi], np.uint32)[w.row], some, w.start, w.end)
                cut = crc % np.uint32(share) == 0
                whole = ~cut & (letters >= least)
                inside = np.repeat(whole, size)
                bounds = np.concatenate(([0], np.cumsum(size[whole])))
                kept = pa.Array.from_buffers(pa.large_binary(), int(whole.sum()), [None, pa.py_buffer(bounds), pa.py_buffer(some[mask][inside])])
                raw, changed = some.tobytes(), []
                for i in np.flatnonzero(cut & (letters > least)).tolist():
                    run_ = raw[w.start[i] : w.end[i]].decode()
                    at = int(crc[i]) % len(run_)
                    changed.append((run_[:at] + run_[at + 1 :]).encode())
                counts = pa.concat_arrays([kept, pa.array(changed, pa.large_binary())]).value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.binary()).cast(pa.string()), counts.field("counts")], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, letters: int = LETTERS, count: int = COUNT, share: int = SHARE) -> DataFrame:
    """word, n of the words of at least ``letters`` code points and ``count`` occurrences."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return texts.mapInArrow(_words(letters, share), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def trie_edges(spelled: DataFrame, least: int = LETTERS // 2) -> DataFrame:
    """way, node, depth, edges (letter, below, only, n) of the nodes with several words
    below them, from depth ``least`` on.  spelled: way, spell, n, letters."""
    ahead = spelled.select("way", "spell", "n", F.explode(F.sequence(F.lit(least), F.col("letters"))).alias("depth"))
    ahead = ahead.select("way", F.expr("left(spell, depth)").alias("node"), "depth", F.expr("substr(spell, depth + 1, 1)").alias("letter"), "spell", "n")
    edges = ahead.groupBy("way", "node", "depth", "letter").agg(F.count("*").alias("below"), F.max("spell").alias("only"), F.max("n").alias("n"))
    # what holds several words is followed by its own edges, so the word is not kept
    edge = F.struct("letter", "below", F.when(F.col("below") == 1, F.col("only")).alias("only"), "n")
    return edges.groupBy("way", "node", "depth").agg(F.collect_list(edge).alias("edges"), F.sum("below").alias("below")).where("below > 1").drop("below")


_AT = "substr(spell, pos + 1, 1)"
_NEXT = "substr(spell, pos + 2, 1)"
_REST = "substr(spell, pos + 1)"
_TAIL = "substr(e.only, depth + 1)"
#: Where equal letters stand side by side, the last of them is left out.
_LEAVE = f"{_AT} <> {_NEXT}"
_MEETS = f"""case when edits = 1 then {_REST} = {_TAIL}
    else (e.letter > {_AT} and {_AT} <> '' and substr(spell, pos + 2) = substr(e.only, depth + 2)) or ({_LEAVE} and substr(spell, pos + 2) = {_TAIL}) end"""
_STEPS = f"""filter(array(
    if(e.letter = {_AT}, struct(pos + 1 as pos, edits), null),
    if(edits = 0 and e.letter > {_AT}, struct(pos + 1 as pos, 1 as edits), null),
    if(edits = 0 and e.letter = {_NEXT} and {_LEAVE}, struct(pos + 2 as pos, 1 as edits), null)), x -> x is not null)"""
_STATE = ("way", "spell", "n", "pos", "node", "edits")


def frontier_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n, near, near_n of pairs one edit apart, each once."""
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("spell")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("spell"))))
    spelled = words.select("n", F.length("word").alias("letters"), ways.alias("s")).select("s.way", "s.spell", "n", "letters")
    edges = scratch.save(trie_edges(spelled).sort("depth"), "edges")
    deepest = edges.agg(F.max("depth")).first()[0]
    half = F.expr("if(way = 0, letters div 2, letters - letters div 2)")
    fresh = spelled.withColumn("pos", half).select("way", "spell", "n", "pos", F.expr("left(spell, pos)").alias("node"), F.lit(0).alias("edits"))
    fresh = scratch.save(fresh.sort("pos"), "fresh")
    found, moved = [], None
    for depth in range(LETTERS // 2, (deepest or 0) + 1):
        states = fresh.where(F.col("pos") == depth)
        if moved is not None:
            states = states.unionByName(moved)
        met = states.join(edges.where(F.col("depth") == depth), ["way", "node"]).withColumn("e", F.explode("edges")).drop("edges")
        met = met.where(F.expr(f"if(e.below = 1, {_MEETS}, size({_STEPS}) > 0)"))
        step = F.explode(F.expr(f"if(e.below = 1, array(struct(pos, edits)), {_STEPS})"))
        met = met.withColumn("to", step).select("way", "spell", "n", F.col("to.pos").alias("pos"), F.concat("node", "e.letter").alias("node"), F.col("to.edits").alias("edits"), F.col("e.only").alias("only"), F.col("e.n").alias("only_n"))
        out = scratch.save(met, "states")
        found.append(out.where("only is not null"))
        moved = out.where("only is null").select(*_STATE)
    if not found:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    spelt = lambda c: F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c))
    return pairs.select(spelt("spell").alias("word"), "n", spelt("only").alias("near"), F.col("only_n").alias("near_n"))


def _leavings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, at, last, id: hashes of long words without the letter ``at`` (-1: whole);
    last: the letter is the last of equal ones side by side."""
    powers = tk._Powers(tk.WORD_STEP)
    for b in batches:
        for word, name in zip(b.column("word").to_pylist(), b.column("id").to_pylist(), strict=True):
            x = tk.mix(np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64))
            up = powers.upto(len(x) + 1)[0][: len(x)]
            before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up)))
            moved = np.concatenate((np.cumsum(x[1:][::-1] * up[:-1][::-1])[::-1], np.zeros(1, np.uint64)))
            key = np.append(before[:-1] + moved, before[-1])
            last = np.append(np.append(x[1:] != x[:-1], True), True)
            at = np.append(np.arange(len(x)), -1)
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(tk.mix(key))), pa.array(at, pa.int32()), pa.array(last), pa.array(np.full(len(at), name))], names=["key", "at", "last", "id"])


def long_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n, near, near_n of pairs of long words one edit apart, each once."""
    named = words.withColumn("id", F.xxhash64("word"))
    keys = scratch.save(named.select("word", "id").mapInArrow(_leavings, "key long, at int, last boolean, id long"), "leavings")
    out = keys.where("at >= 0")
    replaced = out.alias("x").join(out.alias("y"), ["key", "at"]).where("x.id < y.id").select("at", F.col("x.id").alias("id"), F.col("y.id").alias("near_id"))
    whole = keys.where("at < 0").select("key", F.col("id").alias("near_id"))
    left = out.where("last").select("key", "at", "id").join(whole, "key").select("at", "id", "near_id")
    pairs = replaced.unionByName(left).join(named, "id").join(named.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n")), "near_id")
    same = "left(word, at) = left(near, at) and word <> near and (substr(word, at + 2) = substr(near, at + 2) or substr(word, at + 2) = substr(near, at + 1))"
    return pairs.where(same).select("word", "n", "near", "near_n").distinct()


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words one edit apart.  Both ways hold
    the words of ``LONG + 1`` letters, so that no pair falls between them."""
    short = frontier_pairs(words.where(F.length("word") <= LONG + 1), scratch)
    pairs = short.unionByName(long_pairs(words.where(F.length("word") > LONG), scratch))
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(back).distinct()


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: the last word that forms (word, form) lead to.  Each round doubles the
    steps that a word looks ahead."""
    ahead = scratch.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = scratch.save(ahead.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        scratch.drop(ahead)
        ahead = moved
        if ahead.where("moved").isEmpty():
            return ahead.drop("moved")


def variants(docs: DataFrame, letters: int = LETTERS, count: int = COUNT, share: int = SHARE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that counts."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.save(word_counts(docs, letters, count, share), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_words(words, scratch).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    form = F.when(-F.col("best.less") >= FORM * F.col("n"), F.col("best"))
    near = scratch.save(near.withColumn("form", form).select("word", "n_near", F.col("form.near").alias("form"), (-F.col("form.less")).alias("form_n")), "near")
    last = roots(near.where("form is not null").select("word", "form"), scratch)
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
