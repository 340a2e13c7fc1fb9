"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Blocks of rows (by a seeded hash, so that a rerun or a lost executor finds the same blocks) are counted. Which of a
block's rows go to which shard is settled in numbers first: row b of the matrix says how many of block b's rows each
shard gets, drawn without replacement from the room that the shards have left, so rows add up to the blocks' sizes and
columns to the shards'. Then each block is permuted locally and dealt by the matrix, and each shard is permuted again.

Main path: DataFrame functions only. The matrix has blocks * shards entries, whatever the input's size; the driver draws
it, with counts as integers and probabilities from 40-digit logarithms.
"""

from __future__ import annotations

import json
import random
from decimal import Context, Decimal, localcontext
from functools import lru_cache
from itertools import accumulate
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import documents, fresh, stored

#: Rows that a window orders on its own, about: a block or shard of more is ordered in parts, PARTS at least.
WINDOW, PARTS = 1 << 20, 16


#: The Bernoulli numbers B2 to B24 of Stirling's series.
BERNOULLI = ((1, 6), (-1, 30), (1, 42), (-1, 30), (5, 66), (-691, 2730), (7, 6), (-3617, 510), (43867, 798), (-174611, 330), (854513, 138), (-236364091, 2730))
_EXACT = Context(prec=45)
_TURN = Decimal("6.28318530717958647692528676655900576839433879875021")


@lru_cache(maxsize=1 << 14)
def ln_factorial(n: int) -> Decimal:
    """ln n! to 40 digits: at 1e12 rows that leaves 25 behind the point, where doubles leave none to trust."""
    if n < 256:
        return _EXACT.ln(Decimal(factorial(n)))
    x = Decimal(n)
    with localcontext(_EXACT):
        out = (x + Decimal("0.5")) * x.ln() - x + _TURN.ln() / 2
        for k, (a, b) in enumerate(BERNOULLI, 1):
            out += Decimal(a) / (Decimal(b) * 2 * k * (2 * k - 1) * x ** (2 * k - 1))
        return out


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good. Inversion outwards from the mode, as far as it takes.

    The mode's probability comes from 40-digit logarithms, its neighbours' from ratios of integers in doubles."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    with localcontext(_EXACT):
        ln = lambda a, b: ln_factorial(a) - ln_factorial(b) - ln_factorial(a - b)
        top = float((ln(good, mode) + ln(bad, n - mode) - ln(good + bad, n)).exp())
    while True:
        u = rng.random() - top
        left, right, pl, pr = mode, mode, top, top
        if u <= 0:
            return mode
        while (right < high and pr) or (left > low and pl):
            if right < high and pr:
                pr *= (good - right) * (n - right) / ((right + 1) * (bad - n + right + 1))
                right += 1
                u -= pr
                if u <= 0:
                    return right
            if left > low and pl:
                pl *= left * (bad - n + left) / ((good - left + 1) * (n - left + 1))
                left -= 1
                u -= pl
                if u <= 0:
                    return left
        # What rounding left of the whole (about 1e-12): another draw.


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """matrix[b][s]: how many rows of block b go to shard s. Rows sum to blocks, columns to shards."""
    if sum(blocks) != sum(shards):
        raise ValueError("blocks and shards hold different numbers of rows")
    rng, room, out = random.Random(seed), list(shards), []
    for size in blocks:
        row, left, free = [], size, sum(room)
        for s, r in enumerate(room):
            k = hypergeometric(rng, r, free - r, left) if s < len(room) - 1 else left
            row.append(k)
            left, free = left - k, free - r
        room = [r - k for r, k in zip(room, row, strict=True)]
        out.append(row)
    return out


def uniform_shards(df: DataFrame, key: list[str], shards: int, *, seed: int = 0, blocks: int = 128, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in each shard), a uniform shuffle under the seed.

    key: columns that tell rows apart. Rows equal in all of them are interchangeable: each gets its own slot, and which
    gets which is open. Nulls in key are values like others. An empty df stays empty; with fewer rows than shards some
    shards stay empty. Shard sizes differ by one at most, the larger first. Columns of df named as working columns are
    kept apart by a prefix.
    """
    b, o, q, n_, before_, rank_ = fresh(df, "block", "order", "part", "n", "before", "rank")
    df = df.drop(shard, slot)
    texts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\x00")) for k in key]
    ties = [F.col(f"`{k}`").asc_nulls_first() for k in key]

    def drawn(salt: str) -> Column:
        return F.xxhash64(F.lit(f"{seed}/{salt}"), *texts)

    def placed(rows: DataFrame, group: str, salt: str, parts: int) -> DataFrame:
        """rows with before_ + rank_: the place in a random order of its group. Each window holds a part of a group."""
        rows = rows.withColumn(o, drawn(salt)).withColumn(q, F.pmod(F.shiftright(F.col(o), 3), F.lit(parts)).cast("int"))
        earlier = F.sum(n_).over(Window.partitionBy(group).orderBy(q).rowsBetween(Window.unboundedPreceding, -1))
        counts = rows.groupBy(group, q).agg(F.count(F.lit(1)).alias(n_)).withColumn(before_, F.coalesce(earlier, F.lit(0))).drop(n_)
        rows = rows.withColumn(rank_, F.row_number().over(Window.partitionBy(group, q).orderBy(o, *ties)) - 1)
        return rows.join(F.broadcast(counts), [group, q])  # groups * parts rows: n / WINDOW, or groups * PARTS

    rows = df.withColumn(b, F.pmod(drawn("block"), F.lit(blocks)).cast("int"))
    counted = {r[0]: r[1] for r in rows.groupBy(b).count().collect()}  # `blocks` rows at most
    n = sum(counted.values())
    matrix = communication_matrix([counted.get(k, 0) for k in range(blocks)], [n // shards + (s < n % shards) for s in range(shards)], seed)
    table = F.from_json(F.lit(json.dumps([list(accumulate(row)) for row in matrix])), "array<array<bigint>>")
    place = F.col(before_) + F.col(rank_)
    rows = placed(rows, b, "local", max(PARTS, -(-n // (blocks * WINDOW)))).withColumn(shard, F.size(F.filter(F.element_at(table, F.col(b) + 1), lambda e: e <= place)).cast("int"))
    rows = placed(rows.drop(b, o, q, before_, rank_), shard, "slot", max(PARTS, -(-n // (shards * WINDOW))))
    return rows.withColumn(slot, place.cast("long")).drop(o, q, before_, rank_)


def digest(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """The contract's rows for op7. Size: bytes of the text (null: none) plus 16. Law: counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = uniform_shards(stored(rows), ["doc_id", "size", "text_crc32"], shards, seed=seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
