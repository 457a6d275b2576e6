"""Best-fit packing with swap-based local search.

Documents are turned into token ids, ended by one id, and cut into pieces of at most
``capacity`` ids (the first piece is the short one).  Full pieces are sequences of their
own.  All others, at most one a document, are dealt by hash into blocks of about
``block_pieces``; each block is packed by best-fit decreasing and then improved: starting
from the least filled sequence, one or two documents move to another underfull sequence,
or are exchanged for one or two of its own, so that this becomes as full as any exchange
can make it.  An exchange must raise the sum of squared fills, so the search ends: when no
exchange is left, or when the sequences are as few as their tokens allow.  A sequence that
runs empty is gone.  Only numbers travel to the blocks, never text, and a block costs at
most a part of one open sequence.

Defined cases: a null text is empty (one piece, the end id alone); rows are packed one by
one, so repeated doc_ids give repeated pieces; very long texts are cut into full pieces;
the text of a special token is read as the tokenizer file reads it; an empty table gives
an empty result; columns besides doc_id and text, of any name, are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END_ID = 0
BLOCK_PIECES = 20_000
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECES + ", sequence_id long, offset long"


@cache
def _encoder(tokenizer: str, ranks: str):
    """Ids of a text.  The rank file holds the same vocabulary as the tokenizer file and is
    read several times faster; texts it cannot treat alike go to the tokenizer itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    at = lambda name: name if "/" in name else public_tokenizers.path(name)
    whole = Tokenizer.from_file(at(tokenizer))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(at(ranks), "rb") as f:
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if not any(x in text for x in special):
            try:
                return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            except BaseException as e:
                if type(e).__name__ != "PanicException":  # the regex engine gives up on some very long runs
                    raise
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def _cut(tokenizer: str, ranks: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, ranks)
        end = np.array([end_id], "<u4")
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.concatenate((encode(text.as_py() or ""), end))
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class _Bins:
    """Sequences of one block: their pieces, their free room, and where each piece lies."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.size, self.capacity = sizes.tolist(), capacity
        self.items: list[set[int]] = []
        self.free: list[int] = []
        self.at = [0] * len(self.size)
        open_at: dict[int, list[int]] = defaultdict(list)
        mask = 0
        for i in np.argsort(-sizes, kind="stable").tolist():
            s = self.size[i]
            fits = mask >> s
            if fits:
                room = s + (fits & -fits).bit_length() - 1
                b = open_at[room].pop()
                if not open_at[room]:
                    mask &= ~(1 << room)
                self.items[b].add(i)
            else:
                b, room = len(self.items), capacity
                self.items.append({i})
                self.free.append(capacity)
            self.at[i] = b
            self.free[b] = room - s
            if self.free[b]:
                open_at[self.free[b]].append(b)
                mask |= 1 << self.free[b]

    def offers(self, b: int) -> list[tuple[int, tuple[int, ...]]]:
        """Total size and pieces of what a sequence can give: one piece or two, each total
        in one way of either kind."""
        ones: dict[int, list[int]] = defaultdict(list)
        for i in sorted(self.items[b]):
            ones[self.size[i]].append(i)
        out = [(n, (x[0],)) for n, x in ones.items()]
        twos: dict[int, tuple[int, int]] = {2 * n: (x[0], x[1]) for n, x in ones.items() if len(x) > 1}
        kinds = sorted(ones)
        for k, n in enumerate(kinds):
            for m in kinds[:k]:
                twos.setdefault(n + m, (ones[n][0], ones[m][0]))
        return out + list(twos.items())

    def exchange(self, a: int, give: tuple[int, ...], b: int, take: tuple[int, ...]) -> None:
        for x, y, out in ((a, b, give), (b, a, take)):
            for i in out:
                self.items[x].remove(i)
                self.items[y].add(i)
                self.at[i] = y
                self.free[x] += self.size[i]
                self.free[y] -= self.size[i]

    def lacks(self) -> bool:
        """Whether the tokens would fit into fewer sequences."""
        return sum(f for f, x in zip(self.free, self.items, strict=True) if x) >= self.capacity

    def improve(self) -> bool:
        """One round over all underfull sequences, the least filled first."""
        under = sorted((b for b in range(len(self.items)) if self.items[b] and self.free[b]), key=lambda b: -self.free[b])
        # by the size that would fill a sequence once it has given some pieces, then by theirs
        self.index: dict[int, dict[int, list[tuple[int, tuple[int, ...]]]]] = {}
        self.mask = 0
        for b in under:
            self._enter(b)
        done = False
        for a in under:
            while self.items[a] and self.free[a] and (best := self._best(a)):
                _, give, b, take = best
                self.exchange(a, give, b, take)
                done = True
                self._enter(a)
                self._enter(b)
                if not self.items[a] and not self.lacks():
                    return False
        return done

    def _enter(self, b: int) -> None:
        if self.free[b] and self.items[b]:
            for n, take in [(0, ()), *self.offers(b)]:
                self.index.setdefault(n + self.free[b], {}).setdefault(n, []).append((b, take))
                self.mask |= 1 << (n + self.free[b])

    def _best(self, a: int) -> tuple[int, tuple[int, ...], int, tuple[int, ...]] | None:
        """The exchange that leaves the other sequence fullest: its gap, what a gives, the
        other sequence, what it gives back.  A gap below a's own raises the squared fills."""
        best, gap = None, self.free[a]
        for n, give in sorted(self.offers(a), reverse=True):
            target = n
            while fits := (self.mask >> target) & ((1 << (n + gap - target)) - 1 if n + gap > target else 0):
                target += (fits & -fits).bit_length() - 1
                hit = self._entry(target, n, a, len(give))
                if hit is not None:
                    best, gap = (target - n, give, *hit), target - n
                    break
                target += 1
            if not gap:
                break
        return best

    def _entry(self, target: int, n: int, a: int, given: int) -> tuple[int, tuple[int, ...]] | None:
        """A sequence other than a that n more tokens, for less of its own, fill up to
        target; entries that no longer hold are dropped as they are met."""
        kinds = self.index[target]
        for back in list(kinds):
            entries = kinds[back]
            for k in range(len(entries) - 1, -1, -1):
                b, take = entries[k]
                if self.free[b] != target - back or any(self.at[i] != b for i in take) or not self.items[b]:
                    entries[k] = entries[-1]
                    entries.pop()
                elif b != a and back < n:
                    return b, take
            if not entries:
                del kinds[back]
        if not kinds:
            self.mask &= ~(1 << target)
        return None


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number (from 0, gapless) and offset of each size."""
    bins = _Bins(np.asarray(sizes, np.int64), capacity)
    while bins.lacks() and bins.improve():
        pass
    number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for b, items in enumerate(x for x in bins.items if x):
        at = 0
        for i in sorted(items):
            number[i], offset[i] = b, at
            at += bins.size[i]
    return number, offset


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, ranks: str = RANKS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks, full_blocks = max(1, -(-n // block_pieces)), max(1, -(-size // (capacity * block_pieces)))
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer, ranks, capacity, end_id), _PIECES)

    def one(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        number, offset = pack(x["length"].to_numpy(), capacity) if key[0] >= 0 else (np.arange(len(x)), 0)
        return x.drop(columns="block").assign(sequence_id=(int(key[0]) << 32) + number, offset=offset)

    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("block", F.when(F.col("length") == capacity, -1 - F.pmod(mixed, F.lit(full_blocks))).otherwise(F.pmod(mixed, F.lit(blocks))))
    return dealt.groupBy("block").applyInPandas(one, _PLACED)
