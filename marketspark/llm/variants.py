"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols, so that a word is reduced to a short code over a small alphabet. Of the reduced words
the full one-edit neighbourhood is generated and joined with the reduced vocabulary; what meets is verified on the words
themselves. One edit of a word is one edit, or none, of its reduced word, so no pair is lost.

Each unordered pair is generated from one side. Of two reduced words of one length, the one with the smaller hash generates
the replacement; of two whose lengths differ by one, the longer generates the deletion, which is the other's insertion.
Symbols per length: about as many that reduced words are a few times as many as the vocabulary, whatever its size, so that
few words share one. A deletion is made in the alphabet of the shorter word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import discard, documents, mix, powers, release, stored, tidy

#: Letters of words: runs of these are words.
LETTERS = "A-Za-zÀ-ÿ"
#: Reduced words for each word of the vocabulary, as a power of two; and the fewest and most symbols of an alphabet.
SPARE, FEWEST, MOST = 3, 3, 48
#: Symbols that a task works on at a time.
SYMBOLS = 1 << 20


def occurrences(docs: DataFrame, id_col: str, text: str, noise: int, shortest: int = 1) -> DataFrame:
    """word: each occurrence of a run of `shortest` letters or more, A-Z in lower case. Where `noise` divides the crc32 of `<id>:<word>`, the
    code point at crc32 % length is left out. Null texts have none; a null id is an empty one."""
    run = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1))).alias("run")
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), run)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    w = F.col("run")
    # lower() would change accented letters too; words of one byte a letter have none.
    runs = runs.select("id", F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, upper, upper.lower())).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int, rarest: int) -> DataFrame:
    """word, n, length, id: the words of at least so many code points and occurrences. id: unique, as stored."""
    counted = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rarest)
    return stored(counted.select("word", "n", F.length("word").alias("length"), F.monotonically_increasing_id().alias("id")))


def alphabet(length: int, bits: int) -> int:
    """Symbols for reduced words of this length: symbols ** length is about 2 ** bits."""
    return int(min(MOST, max(FEWEST, np.ceil(2 ** (bits / max(1, length))))))


def symbols(codes: np.ndarray, k: int) -> np.ndarray:
    """The symbol, 0 to k - 1, of each code point."""
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(k)).astype(np.int64)


def reduced(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (symbol + 1) * base ** place up to each place, of the rows of s; and the rows' hashes before mixing."""
    up, _ = powers(s.shape[1] + 1)
    total = np.zeros((s.shape[0], s.shape[1] + 1), np.uint64)
    np.cumsum((s + 1).astype(np.uint64) * up[: s.shape[1]], axis=1, out=total[:, 1:])
    return total, total[:, -1]


def sealed(h: np.ndarray, length: int, k: int) -> np.ndarray:
    """The hash of a reduced word, apart for each length and alphabet."""
    return mix(h + np.uint64(length * 1024 + k)).view(np.int64)


def neighbours(codes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes) of the neighbours that the words generate; codes: code points, words of one length."""
    n, length = codes.shape
    if not n:
        return
    k = alphabet(length, bits)
    s = symbols(codes, k)
    _, h = reduced(s, k)
    own, rows = sealed(h, length, k), np.arange(n)
    yield rows, own
    up, down = powers(length + 1)
    wide = max(1, SYMBOLS // n)
    for lo in range(0, length, wide):
        at = slice(lo, min(length, lo + wide))
        for other in range(k):  # replacements by this symbol
            to = sealed(h[:, None] + (np.uint64(other) - s[:, at].astype(np.uint64)) * up[at], length, k)
            i, j = np.nonzero((to > own[:, None]) & (s[:, at] != other))
            if len(i):
                yield i, to[i, j]
    if length > 1:
        k = alphabet(length - 1, bits)
        s = symbols(codes, k)
        total, h = reduced(s, k)
        new = np.ones(s.shape, bool)  # a letter of a run of equal symbols, whichever goes, leaves the same
        new[:, 1:] = s[:, 1:] != s[:, :-1]
        for lo in range(0, length, wide):
            at = slice(lo, min(length, lo + wide))
            to = total[:, at] + (h[:, None] - total[:, at.start + 1 : at.stop + 1]) * down[1]
            i, j = np.nonzero(new[:, at])
            yield i, sealed(to[i, j], length - 1, k)


def _by_length(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, code points) of words of one length, a bounded number at a time. Batches: id, word."""
    for batch in it:
        ids, words = batch.column(0).to_numpy(), batch.column(1)
        size = pc.utf8_length(words).to_numpy()
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            step = max(1, SYMBOLS // int(length))
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                raw = "".join(words.take(pa.array(some)).to_pylist()).encode("utf-32-le")
                yield ids[some], np.frombuffer(raw, "<u4").reshape(len(some), int(length))
    tidy()


def near_pairs(vocab: DataFrame) -> DataFrame:
    """a, b, word_a, word_b, n_a, n_b: ids, words and counts of each unordered pair of words one edit apart, once.

    vocab: word (distinct, not null, one code point at least), n, length, id."""
    bits = SPARE + max(1, vocab.count().bit_length())
    schema = "code long, id long"

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes in _by_length(it):
            k = alphabet(codes.shape[1], bits)
            _, h = reduced(symbols(codes, k), k)
            yield pa.RecordBatch.from_arrays([pa.array(sealed(h, codes.shape[1], k)), pa.array(ids)], ["code", "id"])

    def around(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes in _by_length(it):
            for rows, to in neighbours(codes, bits):
                for lo in range(0, len(rows), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(to[lo : lo + (1 << 16)]), pa.array(ids[rows[lo : lo + (1 << 16)]])], ["code", "id"])

    words = vocab.select("id", "word")
    there = words.mapInArrow(own, schema).withColumnRenamed("id", "b")
    asked = words.mapInArrow(around, schema).withColumnRenamed("id", "a")
    # A word meets itself and, in its own reduced word, every other twice: b > a keeps one. Other pairs meet once.
    met = stored(asked.join(there, "code").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release(vocab.sparkSession)
    first, second = (vocab.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = met.join(first, "a").join(second, "b").where(F.levenshtein("word_a", "word_b", 1) == 1)
    out = stored(pairs.select("a", "b", "word_a", "word_b", "n_a", "n_b"))
    discard(met)
    return out


def variants(vocab: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of vocab.

    form: the near word of the largest count (ties: the smallest in code point order), if that is at least `ratio` times
    the word's own, else null. root: the last of the forms that follow from the word, the word itself if it has none.
    Counts at least double from form to form (ratio of 2 or more), so there is no cycle and few steps; they are followed by
    doubling."""
    pairs = near_pairs(vocab)
    sides = F.array(F.struct(F.col("a").alias("id"), F.struct((-F.col("n_b")).alias("n"), F.col("word_b").alias("word"), F.col("b").alias("id")).alias("near")), F.struct(F.col("b").alias("id"), F.struct((-F.col("n_a")).alias("n"), F.col("word_a").alias("word"), F.col("a").alias("id")).alias("near")))
    each = pairs.select(F.inline(sides))
    best = each.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    takes = -F.col("near.n") >= ratio * F.col("n")
    forms = vocab.join(best, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(takes, x).alias(y) for x, y in ((F.col("near.word"), "form"), (-F.col("near.n"), "form_n"), (F.col("near.id"), "to"))])
    forms = stored(forms)
    to = forms.select("id", "to").where("to is not null")
    while True:  # `to` skips twice as far each round: 6 rounds at most, as counts double
        ahead = to.select(F.col("id").alias("to"), F.col("to").alias("further"))
        next_ = stored(to.join(ahead, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        if next_.where("moved").isEmpty():
            break
        to = next_.select("id", "to")
    last = next_.select("id", F.col("to").alias("last"))
    names = forms.select(F.col("id").alias("last"), F.col("word").alias("root"))
    roots = last.join(names, "last").select("id", "root")
    return forms.join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame, noise: int = 97, shortest: int = 5, rarest: int = 3) -> DataFrame:
    """The contract's rows for op12. Repeated rows count as often as they are there; a table without words gives none."""
    return variants(vocabulary(occurrences(docs, "doc_id", "text", noise, shortest), shortest, rarest))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
