"""Best-fit packing of token pieces into sequences by a swap-based local search.

Documents are tokenized where they lie; only (document, piece, length, checksum) rows move. Groups of rows of bounded size
are packed on their own. They start as they arrive, unsorted, each in the bin that it fits best. Then the
emptiest bin gives to the fuller ones: a move into the bin that it fits best, or a one-for-one or two-for-one exchange that
leaves the taker the least room. Every step raises the sum of squared fills, so bins run full or empty. The search ends after
a round over all underfull bins that empties none, or where no bin can be saved. The underfull bins of all groups are then searched again together, round by
round, until they are one group's or a round saves nothing.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import documents, stored

#: Rows that are packed together.
GROUP = 20_000
#: Texts of these characters alone are split alike by both libraries; others go to `tokenizers` itself.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")
END = "<|endoftext|>"


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path of a public tokenizer's file without its ending."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json").removesuffix(".json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> numpy uint32 ids, as tokenizers.Tokenizer.encode(text, add_special_tokens=False) gives them.

    tiktoken over the same merges is several times faster and gives the same ids on plain texts; texts with other
    characters or with a special token's name go to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(f"{path}.json")
    with open(f"{path}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if END not in text and PLAIN.fullmatch(text):
            return np.array(fast.encode_ordinary(text), "<u4")
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def tokenized(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt. The ids of a document end in id 0; its first piece may be short.

    A null text is empty. salt numbers the rows of a partition, so that rows that are alike can be dealt apart.
    """
    kind = docs.schema["doc_id"].dataType
    cast = docs.select("doc_id", "text")
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, salt long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt = encoder(path), 0
        for batch in it:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
                lo, k, n = 0, 0, len(ids)
                while lo < n:
                    hi = lo + ((n % capacity or capacity) if not lo else capacity)
                    at.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
                    lo, k = hi, k + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(range(salt, salt + len(at)), pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
            salt += len(at)

    return cast.mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers in the order given: each item into the bin that it leaves the least room, else into a new one."""
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i, x in enumerate(lengths):
        if x > capacity:
            raise ValueError(f"an item of {x} doesn't fit into {capacity}")
        fit = mask >> x
        if fit:
            room = x + (fit & -fit).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        room -= x
        if room:
            open_[room].append(b)
            mask |= 1 << room
    return bins


class Search:
    """Local search over bins of items: moves, one-for-one and two-for-one exchanges from an underfull bin to fuller ones."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.capacity, self.size = capacity, np.array(lengths, np.int64)
        self.bins = [list(b) for b in bins]
        self.at = np.empty(len(lengths), np.int64)
        self.room = np.array([capacity - sum(lengths[i] for i in b) for b in bins], np.int64)
        for k, b in enumerate(bins):
            self.at[b] = k
        # Underfull bins by room, and a bit for each room that some bin has.
        self.by: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0
        for k in range(len(bins)):
            self._enter(k)
        self.live, self.most = np.arange(len(lengths)), capacity

    def _enter(self, k: int) -> None:
        r = int(self.room[k])
        if r and self.bins[k]:
            self.by[r].add(k)
            self.mask |= 1 << r

    def _leave(self, k: int) -> None:
        r = int(self.room[k])
        self.by[r].discard(k)
        if not self.by[r]:
            self.mask &= ~(1 << r)

    def shift(self, giver: int, taker: int, out: list[int], back: list[int]) -> None:
        """Items `out` go from giver to taker, `back` the other way. The giver is not among the underfull bins meanwhile."""
        self._leave(taker)
        for i in out:
            self.bins[giver].remove(i)
            self.at[i] = taker
        for i in back:
            self.bins[taker].remove(i)
            self.at[i] = giver
        self.bins[taker] += out
        self.bins[giver] += back
        gain = int(self.size[out].sum() - self.size[back].sum())
        self.room[taker] -= gain
        self.room[giver] += gain
        self._enter(taker)

    def partner(self, x: int, giver: int) -> int | None:
        """The item smaller than x in another underfull bin, of `most` room, that leaves it the least room if x takes its place."""
        at = self.at[self.live]
        size, room = self.size[self.live], self.room[at]
        left = size + room - x
        ok = np.flatnonzero((size < x) & (left >= 0) & (room > 0) & (room <= self.most) & (at != giver))
        return int(self.live[ok[left[ok].argmin()]]) if len(ok) else None

    def step(self, giver: int) -> bool:
        """One move or exchange that fills a taker the most; False where none is left."""
        mine = sorted(self.bins[giver], key=lambda i: (-self.size[i], i))
        tried = set()
        for i in mine:
            x = int(self.size[i])
            if x in tried:
                continue
            tried.add(x)
            fit = (self.mask & ((2 << self.most) - 1)) >> x
            if fit:
                taker = min(self.by[x + (fit & -fit).bit_length() - 1])
                self.shift(giver, taker, [i], [])
                return True
            j = self.partner(x, giver)
            if j is not None:
                self.shift(giver, int(self.at[j]), [i], [j])
                return True
        # Two for one: the sums that the giver's pairs make, each once.
        pairs: dict[int, tuple[int, int]] = {}
        for k, i in enumerate(mine):
            for j in mine[k + 1 :]:
                pairs.setdefault(int(self.size[i] + self.size[j]), (i, j))
        best = None
        for x in sorted(pairs):
            j = self.partner(x, giver)
            if j is not None:
                left = int(self.size[j] + self.room[self.at[j]]) - x
                if best is None or left < best[0]:
                    best = (left, x, j)
                if not left:
                    break
        if best is None:
            return False
        self.shift(giver, int(self.at[best[2]]), list(pairs[best[1]]), [best[2]])
        return True

    def run(self) -> list[list[int]]:
        """Rounds in which each underfull bin, the emptiest first, gives until it is empty or no step is left for it. Ends
        after a round that empties no bin, or with as few bins as the sum of lengths allows. Every item stays in one bin."""
        least = -(-int(self.size.sum()) // self.capacity)
        count = sum(map(bool, self.bins))
        before = count + 1
        while least < count < before:
            before = count
            todo = sorted((k for k, b in enumerate(self.bins) if b and self.room[k]), key=lambda k: (-self.room[k], k))
            for giver in todo:
                if count <= least:
                    break
                if not self.bins[giver] or not self.room[giver]:
                    continue
                if len(self.live) > 64 and (gone := (self.room[self.at[self.live]] == 0).mean()) > 0.1 and gone:
                    self.live = self.live[self.room[self.at[self.live]] > 0]
                self._leave(giver)
                # Fuller bins take: as the giver only loses and takers only gain, each step raises the sum of squares.
                self.most = int(self.room[giver])
                while self.bins[giver] and self.step(giver):
                    pass
                self._enter(giver)
                count -= not self.bins[giver]
        return [b for b in self.bins if b]


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """The local search from the given bins: never more bins than before."""
    return Search(bins, lengths, capacity).run()


def pack_group(pdf: pd.DataFrame, capacity: int, group: int) -> pd.DataFrame:
    """Rows of a group with sequence_id, offset and full. Rows that have a sequence_id start in it, others as they come."""
    pdf = pdf.sort_values(["sequence_id", "offset", "doc_id", "piece", "ids_crc32", "salt"], kind="stable").reset_index(drop=True)
    lengths = pdf["length"].tolist()
    if len(pdf) and pdf["sequence_id"].iloc[0] >= 0:
        cut = np.flatnonzero(pdf["sequence_id"].diff().fillna(1).to_numpy())
        start = [x.tolist() for x in np.split(np.arange(len(pdf)), cut[1:])]
    else:
        start = best_fit(lengths, capacity)
    sequence, offset, full = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
    for k, b in enumerate(improve(start, lengths, capacity)):
        at = 0
        for i in b:
            sequence[i], offset[i] = (group << 32) + k, at
            at += lengths[i]
        full[b] = at == capacity
    return pdf.assign(sequence_id=sequence, offset=offset, full=full)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. docs needs doc_id and text.

    Null texts and null doc_ids are packed like others; an empty text is the end id alone; rows that are alike are
    packed each on its own. Other columns of docs are ignored. An empty table gives no rows. Never more than `capacity`
    tokens a sequence; the rows of a sequence lie gapless from offset 0.
    """
    rows = stored(tokenized(docs, path or vocabulary(), capacity))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt long, sequence_id long, offset long, full boolean, g long"

    def searched(df: DataFrame, by: list[str], groups: int, first: int) -> DataFrame:
        deal = F.pmod(F.xxhash64(*by, F.lit(first)), F.lit(groups)) + first
        return df.withColumn("g", deal.cast("long")).groupBy("g").applyInPandas(lambda key, pdf: pack_group(pdf.drop(columns="g"), capacity, key[0]).assign(g=key[0]), schema)

    left = rows.count()
    groups, first, done = max(1, -(-left // group)), 0, []
    rest = rows.withColumn("sequence_id", F.lit(-1).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    by = ["doc_id", "piece", "ids_crc32", "salt"]
    while True:
        out = searched(rest, by, groups, first)
        if groups == 1:
            done.append(out)
            break
        out = stored(out)
        # Whole underfull bins of all groups go into as few groups as hold them.
        under = out.where("not full")
        more = under.count()
        if more == left:
            done.append(out)
            break
        done.append(out.where("full"))
        rest, by, left, first = under.drop("full", "g"), ["sequence_id"], more, first + groups
        groups = max(1, -(-left // group))
    whole = reduce(DataFrame.unionByName, done)
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
