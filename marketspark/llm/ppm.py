"""Language-model scoring by prediction by partial matching, beside a smoothed unigram score.

Training texts are counted whole: each byte (and each text's end) with the ORDER symbols before it. The counts of all
shorter contexts follow by adding up, which makes a trie of contexts. A symbol is coded in the longest context that was
seen; one that is new there costs an escape (each distinct symbol of the context gives half a count for it), and shorter
contexts leave out the symbols that the longer one had (symbol exclusion). What no context knows is uniform over the symbols left.

Given a trained trie the code length of a symbol depends on its ORDER + 1 symbols alone, so those of all trained strings are
looked up in one table, and only others walk down the trie. The trie is broadcast where it has `TRIE` strings at most; a
larger one is dealt into slices by the last two context symbols, each broadcast in turn, and the parts are added up.

Word counts are exact: the most frequent words (a table of bounded size) are looked up where the text lies, the rest is
joined by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import LOWER, batches, documents, fold, span_hashes, stored, word_spans

ORDER = 5
BITS = 9
#: The symbol before and after a text; bytes are 0 to 255.
EDGE = 256
SYMBOLS = 257
#: Strings of a slice of the trie, and words of the broadcast table, at most.
TRIE = 3 << 20
HEAD = 1 << 19
#: Bytes of text that a task works on at a time: its arrays are some hundred times as large.
PIECE = 1 << 19
#: The hash that stands for a text's end among the words.
END = np.uint64(0x1D8E4E27C47D124F)


def strings(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol with the `order` before it, packed, document by document; and where each document's begin."""
    n = np.diff(offsets)
    at = np.zeros(len(offsets), np.int64)
    np.cumsum(n + order + 1, out=at[1:])
    s = np.full(at[-1], EDGE, np.int64)
    if len(data):
        s[np.arange(len(data)) + np.repeat(np.arange(len(n)) * (order + 1) + order, n)] = data
    g = np.zeros(len(s), np.int64)
    for k in range(order + 1):
        g[: len(s) - k] = (g[: len(s) - k] << BITS) | s[k:]
    keep = np.ones(len(s), bool)
    for k in range(order):
        keep[at[1:] - 1 - k] = False
    begin = np.zeros(len(offsets), np.int64)
    np.cumsum(n + 1, out=begin[1:])
    return g[keep], begin


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words, and their documents; ends are not among them."""
    low = LOWER[data]
    starts, ends, doc = word_spans(low, offsets)
    return span_hashes(low, starts, ends), doc


class Table:
    """Integers -> positions, by open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.int64)
        self.size = 1 << max(4, int(1.4 * len(keys)).bit_length())
        self.slots = np.full(self.size, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(self.keys)
        while len(left):
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.slots[at[first]] = left[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & (self.size - 1)

    def _home(self, x: np.ndarray) -> np.ndarray:
        return ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self.size - 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Position of each key; -1 where it isn't there."""
        at = self._home(x)
        out = self.slots[at]
        if not len(self.keys):
            return out
        todo = np.flatnonzero((self.keys[out] != x) & (out >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (self.size - 1)
            got = self.slots[at[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[got] != x[todo])]
        return out


class Trie:
    """Counts of all contexts up to `order`, from strings of order + 1 symbols. `short`: (string, count) of the two shortest
    orders' strings where the given ones are a slice."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, short: tuple[np.ndarray, np.ndarray] | None = None):
        self.order, self.levels = order, []
        for k in range(order + 1):
            src, n = (keys, counts) if short is None or k > 1 else short
            key = src & ((1 << BITS * (k + 1)) - 1)
            key, at = np.unique(key, return_inverse=True)
            count = np.bincount(at, weights=n, minlength=len(key)) if len(key) else np.zeros(0)
            ctx, at = np.unique(key >> BITS, return_inverse=True)
            total = np.bincount(at, weights=count, minlength=len(ctx)) if len(ctx) else np.zeros(0)
            kinds = np.bincount(at, minlength=len(ctx)).astype(np.float64)
            mass = np.zeros(len(ctx))
            if k and len(ctx):
                pk, pc = self.levels[-1][0], self.levels[-1][1]
                low = key & ((1 << BITS * k) - 1)
                i = np.minimum(np.searchsorted(pk, low), len(pk) - 1)
                mass = np.bincount(at, weights=np.where(pk[i] == low, pc[i], 0.0), minlength=len(ctx))
            self.levels.append((key, count, ctx, total, kinds, mass))
        key, count, ctx, total, kinds, _ = self.levels[order]
        i = np.searchsorted(ctx, key >> BITS)
        self.known = Table(key)
        self.log = np.log10((count - 0.5) / total[i]).astype(np.float64) if len(key) else np.zeros(0)

    def walk(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of each string's last symbol after the others."""
        out, done = np.zeros(len(g)), np.zeros(len(g), bool)
        mass, kinds = np.zeros(len(g)), np.zeros(len(g))
        for k in range(self.order, -1, -1):
            key, count, ctx, total, kind, lower = self.levels[k]
            if not len(key):
                continue
            want = g & ((1 << BITS * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(ctx, want >> BITS), len(ctx) - 1)
            here = ~done & (ctx[c] == want >> BITS)
            s = np.minimum(np.searchsorted(key, want), len(key) - 1)
            new = kind[c] - kinds
            left = total[c] - mass
            hit = here & (key[s] == want)
            out[hit] += np.log10((count[s][hit] - 0.5) / left[hit])
            esc = here & ~hit & (new > 0)
            out[esc] += np.log10(0.5 * new[esc] / left[esc])
            done |= hit
            mass, kinds = np.where(here, lower[c], mass), np.where(here, kind[c], kinds)
        rest = ~done
        out[rest] -= np.log10(np.maximum(1.0, SYMBOLS - kinds[rest]))
        return out

    def score(self, g: np.ndarray) -> np.ndarray:
        at = self.known.find(g)
        miss = at < 0
        out = self.log[at] if len(self.log) else np.zeros(len(g))
        if miss.any():
            kinds, back = np.unique(g[miss], return_inverse=True)
            out[miss] = self.walk(kinds)[back]
        return out


def adaptive(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text under a trie that starts empty and learns each symbol after coding it."""
    seen: list[dict[tuple, dict[int, int]]] = [{} for _ in range(order + 1)]
    s, total = [EDGE] * order + list(text) + [EDGE], 0.0
    for i in range(order, len(s)):
        out: set[int] = set()
        for k in range(order, -1, -1):
            have = seen[k].get(tuple(s[i - k : i]))
            if have is None:
                continue
            new = {a: n for a, n in have.items() if a not in out}
            if not new:
                continue
            left = sum(new.values())
            if s[i] in new:
                total += np.log10((new[s[i]] - 0.5) / left)
                break
            total += np.log10(0.5 * len(new) / left)
            out |= set(new)
        else:
            total -= np.log10(SYMBOLS - len(out))
        for k in range(order + 1):
            at = seen[k].setdefault(tuple(s[i - k : i]), {})
            at[s[i]] = at.get(s[i], 0) + 1
    return float(total)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)


def counted(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """kind (0: strings, 1: words), key, n over all of docs' texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: tuple[tuple[list, list], tuple[list, list]] = (([], []), ([], []))
        size = [0, 0]

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            k, n = summed(*got[kind])
            got[kind][0].clear()
            got[kind][1].clear()
            size[kind] = 0
            for lo in range(0, len(k), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[part]), kind, np.int32)), pa.array(k[part]), pa.array(n[part])], ["kind", "key", "n"])

        for _, data, offsets in batches(it, most=PIECE):
            h, doc = words(data, offsets)
            h = np.append(h, np.full(len(offsets) - 1, END)).view(np.int64)
            for kind, x in ((0, strings(data, offsets, order)[0]), (1, h)):
                k, n = np.unique(x, return_counts=True)
                got[kind][0].append(k)
                got[kind][1].append(n)
                size[kind] += len(k)
                if size[kind] > 2 << 20:
                    k, n = summed(*got[kind])
                    got[kind][0][:], got[kind][1][:], size[kind] = [k], [n], len(k)
                    if len(k) > 1 << 20:
                        yield from flush(kind)
        for kind in (0, 1):
            if got[kind][0]:
                yield from flush(kind)

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow()  # as Arrow columns: no Python object for a row
    key, n = t.column("key").to_numpy(), t.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def score(docs: DataFrame, train: DataFrame, order: int = ORDER, trie: int = TRIE, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens (long), base_score, score (double), a row for each of docs'.

    train: rows with text. Tokens are the words and one end a text; a null text is empty. An empty train leaves every
    symbol as likely as any other and the base score at log10(1/1) a token. Rows of equal doc_id, null ones too, stay apart;
    rows of equal text have equal scores. Other columns of docs are ignored; an empty docs gives no rows. How docs' rows are
    dealt to tasks has no say, in a rerun neither.
    """
    spark = docs.sparkSession
    counts = stored(counted(train, order))
    grams, vocab = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n")
    total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = total["n"], total["v"]
    # The most frequent words, whole counts at a time, as many as `head` holds.
    least, have = 1, 0
    if kinds > head:
        # `head` words can't have more than so many different counts above the least.
        for r in vocab.groupBy("n").count().orderBy(F.desc("n")).limit(head).toLocalIterator():
            have += r["count"]
            if have > head:
                least = r["n"] + 1
                break
    word, times = _arrays(vocab.where(F.col("n") >= least))
    table = spark.sparkContext.broadcast((Table(word), np.append(times, 0)))
    slices = max(1, -(-grams.count() // trie))
    short = None
    if slices > 1:
        short = _arrays(grams.groupBy(F.col("key").bitwiseAND((1 << 2 * BITS) - 1).alias("key")).agg(F.sum("n").alias("n")))
    schema = "text_id binary, doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", n_tokens long, n_known long, base double, score double, rest array<long>"
    share = tokens + 0.5 * (kinds + 1)
    whole = least == 1

    def scoring(model, slice_: int):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie_ = model.value
            for batch, data, offsets in batches(it, most=PIECE):
                n = len(offsets) - 1
                g, begin = strings(data, offsets, order)
                if slices > 1:
                    mine = _slice_of((g >> BITS) & ((1 << 2 * BITS) - 1), slices) == slice_
                    lp = np.zeros(len(g))
                    lp[mine] = trie_.score(g[mine])
                else:
                    lp = trie_.score(g)
                lp = np.append(0, np.cumsum(lp))
                code = lp[begin[1:]] - lp[begin[:-1]]
                raw = data.tobytes()
                ids = pa.array([blake2b(raw[a:b], digest_size=16).digest() if slices > 1 or not whole else b"" for a, b in pairwise(offsets.tolist())], pa.binary())
                if slice_:
                    zero = pa.array(np.zeros(n, np.int64))
                    rest = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array(np.zeros(0, np.int64)))
                    yield pa.RecordBatch.from_arrays([ids, batch.column(0), zero, zero, pa.array(np.zeros(n)), pa.array(code), rest], ["text_id", "doc_id", "n_tokens", "n_known", "base", "score", "rest"])
                    continue
                h, doc = words(data, offsets)
                h, doc = np.append(h, np.full(n, END)).view(np.int64), np.append(doc, np.arange(n))
                t, c = table.value
                c = c[t.find(h)]
                known = c > 0
                use = known | whole
                logs = np.log10((c + 0.5) / share)
                base = np.bincount(doc[use], weights=logs[use], minlength=n)
                r = np.flatnonzero(~use)
                r = r[np.argsort(doc[r], kind="stable")]
                o = np.append(0, np.cumsum(np.bincount(doc[r], minlength=n)))
                rest = pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(h[r]))
                yield pa.RecordBatch.from_arrays([ids, batch.column(0), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[known], minlength=n)), pa.array(base), pa.array(code), rest], ["text_id", "doc_id", "n_tokens", "n_known", "base", "score", "rest"])

        return run

    parts = []
    for k in range(slices):
        own = _arrays(grams if slices == 1 else grams.where(_slice_column(slices) == k))
        model = spark.sparkContext.broadcast(Trie(*own, order, short))
        parts.append(stored(docs.select("doc_id", "text").mapInArrow(scoring(model, k), schema)))
        model.unpersist()
    rows = parts[0]
    # A score is a text's alone, so what belongs together is found by a hash of the text, however the rows were read. Of
    # rows with one text, one is joined.
    if slices > 1:
        more = reduce(DataFrame.unionByName, [p.groupBy("text_id").agg(F.first("score").alias("more")) for p in parts[1:]])
        rows = rows.join(more.groupBy("text_id").agg(F.sum("more").alias("more")), "text_id").withColumn("score", F.col("score") + F.col("more")).drop("more")
    if not whole:
        rare = rows.groupBy("text_id").agg(F.first("rest").alias("rest")).select("text_id", F.explode("rest").alias("key")).join(vocab.where(F.col("n") < least), "key", "left")
        n = F.coalesce("n", F.lit(0))
        rare = rare.groupBy("text_id").agg(F.sum(F.log10((n + 0.5) / F.lit(share))).alias("add"), F.sum((n > 0).cast("long")).alias("known"))
        rows = rows.join(rare, "text_id", "left").withColumn("base", F.col("base") + F.coalesce("add", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("known", F.lit(0)))
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def _slice_of(pair: np.ndarray, slices: int) -> np.ndarray:
    return (pair * 40503 >> 4) % slices


def _slice_column(slices: int):
    pair = F.shiftright("key", BITS).bitwiseAND((1 << 2 * BITS) - 1)
    return F.shiftright(pair * 40503, 4) % slices


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for op9: learned from rows whose crc32(doc_id as text) mod 5 is not 1."""
    docs = documents(spark, sf_dir)
    out = score(docs, docs.where(fold("doc_id", 5) != 1))
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
