"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within their source. Whole passes over a source are taken as often as its target
allows; what is left of the target is filled by length counts: a share of every length, then a bounded-knapsack dynamic
programme over the lengths that are left closes the rest to the word. Seeded hashes pick the documents of each length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import documents, fresh, put_back, set_aside, stored

#: What the dynamic programme closes, in words; the share of lengths before it leaves no more than that.
DP_WORDS = 1 << 16
#: Parts of the documents of one source and length that are ordered on their own.
BUCKETS = 256


def words(text: str | Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D] (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], budget: float, cap: float) -> list[float]:
    """Shares of budget by weight, none above cap times its size; what is cut off goes to the others by weight."""
    out, rest, left = [0.0] * len(sizes), float(budget), float(sum(weights))
    for i in sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i)):
        out[i] = min(cap * sizes[i], max(0.0, rest) * weights[i] / left)
        rest, left = rest - out[i], left - weights[i]
    return out


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take, counts at most, so that their words come nearest below budget."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    share = [int(c) * budget // total for c in counts]
    taken = np.array(share, np.int64)
    rest = budget - int((lengths * taken).sum())
    for i in sorted(range(len(lengths)), key=lambda i: (-(int(counts[i]) * budget % total), i)):
        if rest <= most:
            break
        k = min(int(counts[i] - taken[i]), max(1, (rest - most) // max(1, int(lengths[i]))), rest // max(1, int(lengths[i])))
        taken[i] += k
        rest -= k * int(lengths[i])
    # Bounded knapsack: by[w] is the part that first reached w words; parts are powers of two of a length.
    parts: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        free, k, size = int(counts[i] - taken[i]), 1, int(lengths[i])
        while free > 0 and 0 < size <= rest:
            parts.append((int(i), min(k, free)))
            free -= k
            k *= 2
    by = np.full(rest + 1, -1, np.int64)
    by[0] = len(parts)
    for p, (i, k) in enumerate(parts):
        size = k * int(lengths[i])
        if size > rest:
            continue
        new = np.flatnonzero((by[:-size] >= 0) & (by[size:] < 0)) + size
        by[new] = p
        if by[rest] >= 0:
            break
    w = int(np.flatnonzero(by >= 0)[-1])
    while w:
        i, k = parts[by[w]]
        taken[i] += k
        w -= k * int(lengths[i])
    return taken


def mix(df: DataFrame, size: str, weigh: Callable[[int, str | None], float], *, share: float = 1.5, cap: float = 2.0, source: str = "source", seed: int = 0, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """df with source_size long, target double and copies int: how often the mix takes the row whole.

    weigh(i, name) is the weight of the i-th source by code point, null last. Targets share `share` times all sizes by
    weight, `cap` times a source's size at most. Rows of size 0 or null are never taken. Sources of size 0 have target 0.
    Which of several rows of one length are taken goes by a seeded hash of `key` (rows equal there and in size are
    interchangeable). An empty df stays empty. Columns of df with the new columns' names are replaced.
    One row a source goes to the driver, which sets the weights.
    """
    s, n, o, b, quota, base, before, rank = fresh(df, "source", "n", "order", "bucket", "quota", "base", "before", "rank")
    df = df.drop("source_size", "target", "copies").withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long"))
    rows = df.withColumn(s, F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))))
    rows = rows.withColumn(o, F.xxhash64(F.lit(seed), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\x00")) for k in key]))
    rows = rows.withColumn(b, F.pmod(F.col(o), F.lit(BUCKETS)).cast("int"))
    counts = stored(rows.groupBy(s, size, b).agg(F.count(F.lit(1)).alias(n)))
    totals = {r[0]: int(r[1] or 0) for r in counts.groupBy(s).agg(F.sum(F.col(size) * F.col(n))).collect()}
    names = sorted(totals, key=lambda x: (x == "n", x.encode("utf-8", "surrogatepass")))
    targets = water_fill([totals[x] for x in names], [weigh(i, None if x == "n" else x[1:]) for i, x in enumerate(names)], share * sum(totals.values()), cap) if names else []
    spark = df.sparkSession
    table = spark.createDataFrame([(x, totals[x], float(t)) for x, t in zip(names, targets, strict=True)], f"{s} string, source_size long, target double")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(int(target // total), int(cap)) if total else 0
        got = fill(pdf[size].to_numpy(), pdf[n].to_numpy(), round(target - passes * total)) if total else np.zeros(len(pdf), np.int64)
        return pd.DataFrame({s: pdf[s], size: pdf[size], base: passes, quota: got})

    lengths = counts.where(F.col(size) > 0).groupBy(s, size).agg(F.sum(n).alias(n)).join(table, s)
    plan = stored(lengths.groupBy(s).applyInPandas(fit, f"{s} string, {size} long, {base} int, {quota} long"))
    earlier = F.coalesce(F.sum(n).over(Window.partitionBy(s, size).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.withColumn(before, earlier).join(plan, [s, size], "left").select(s, size, b, F.coalesce(base, F.lit(0)).alias(base), (F.coalesce(quota, F.lit(0)) - F.col(before)).alias(quota))
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy(s, size, b).orderBy(o, *[F.col(f"`{k}`").asc_nulls_first() for k in key])))
    rows = rows.join(cells, [s, size, b]).join(table, s)
    copies = (F.col(base) + (F.col(rank) <= F.col(quota)).cast("int")).cast("int")
    return rows.withColumn("copies", F.when(F.col(size) > 0, copies).otherwise(0)).drop(s, o, b, rank, base, quota)


def repeating(i: int, name: str | None = None) -> float:
    """The contract's weights: 3, 1, 2, repeating."""
    return (3.0, 1.0, 2.0)[i % 3]


def digest(docs: DataFrame, seed: int = 6) -> DataFrame:
    """The contract's rows for op6. Nulls, ties and empty tables: as in mix(); rows of size 0 have taken 0."""
    rows = stored(docs.select("doc_id", "source", words("text").alias("size")))
    out = mix(rows, "size", repeating, seed=seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = 6) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs, whatever their names.

    Documents without words (null, empty) are never taken; a null source is one of its own; which of rows of equal doc_id and
    size are taken is open; an empty table stays empty."""
    docs, names = set_aside(docs, ("source_size", "target", "copies"))
    (size,) = fresh(docs, "words")
    out = mix(docs.withColumn(size, words("text")), size, repeating, seed=seed)
    return put_back(out.where("copies > 0").withColumn("copies", F.explode(F.expr("sequence(1, copies)"))), names)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
