"""Exact order statistics of keys of any size: values are counted by range, the cumulative counts tell which ranges hold the
wanted ranks, and only these are looked at again. No key is collected or sorted whole, whatever its share of the rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.graph import cut

#: Ranges that a range is cut into, and rows of a range that are sorted at last.
RANGES, SORTED = 256, 10_000


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """keys, n, low, high, mean, at: `at` are the values at the ranks (from 1, by order of value) that ranks(n) gives, in that
    order. Null and NaN values don't count; a rank outside 1 to n, or null, has a null value. Keys without values are left
    out. Infinite values are an error of the caller's."""
    v = F.col(value).cast("double")
    base = rows.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    facts = cut(base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.avg("_v").alias("mean")))
    wanted = F.array(*[r.cast("bigint") for r in ranks(F.col("n"))])
    in_range = F.filter(F.array_distinct(wanted), lambda r: r.between(1, F.col("n")))
    # A cell is a range of a key's values that holds wanted ranks; `before` rows of the key are below it.
    cells = facts.select(*keys, F.col("low").alias("_lo"), F.col("high").alias("_hi"), F.lit(0).cast("bigint").alias("_before"), F.col("n").alias("_n"), in_range.alias("_ranks")).where(F.size("_ranks") > 0)
    # Keys of few rows are sorted as they are, others counted by range first.
    one = lambda c: c.where("_lo = _hi").select(*keys, F.explode("_ranks").alias("rank"), F.col("_lo").alias("at"))
    few, many = (F.col("_lo") < F.col("_hi")) & (F.col("_n") <= SORTED), (F.col("_lo") < F.col("_hi")) & (F.col("_n") > SORTED)
    found, small, cells = [one(cells)], [cells.where(few)], cells.where(many)
    while not cells.isEmpty():
        inside = base.join(cells.drop("_n"), keys).where("_v between _lo and _hi")
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        bucket = F.least(F.lit(RANGES - 1), F.floor(share * RANGES)).cast("int")
        counted = inside.groupBy(*keys, "_lo", "_before", "_ranks", bucket.alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
        below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_lo").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_before")
        next_ = counted.select(*keys, F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), below.alias("_before"), "_n", "_ranks")
        held = F.filter("_ranks", lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_n")))
        next_ = cut(next_.withColumn("_ranks", held).where(F.size("_ranks") > 0))
        found.append(one(next_))
        small.append(next_.where(few))
        cells = next_.where(many)
    placed = base.join(reduce(DataFrame.unionByName, [c.select(*cells.columns) for c in small]), keys).where("_v between _lo and _hi").withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_lo").orderBy("_v")) + F.col("_before"))
    found.append(placed.where(F.array_contains("_ranks", F.col("rank").cast("bigint"))).select(*keys, F.col("rank").cast("bigint").alias("rank"), F.col("_v").alias("at")))
    by_rank = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("_m"))
    return facts.join(by_rank, keys, "left").select(*keys, "n", "low", "high", "mean", F.transform(wanted, lambda r: F.try_element_at("_m", r)).alias("at"))


def quantiles(rows: DataFrame, keys: list[str], value: str, *shares: float) -> DataFrame:
    """keys, n, low, high, mean, q: the linearly interpolated quantiles, exact, in the order of `shares`."""
    place = lambda p, n: p * (n - 1)
    pairs = lambda n: [r for p in shares for r in (F.floor(place(p, n)) + 1, F.ceil(place(p, n)) + 1)]
    out = at_ranks(rows, keys, value, pairs)
    n = F.col("n")
    part = lambda k, p: F.element_at("at", 2 * k + 1) + (place(p, n) - F.floor(place(p, n))) * (F.element_at("at", 2 * k + 2) - F.element_at("at", 2 * k + 1))
    return out.select(*keys, "n", "low", "high", "mean", F.array(*[part(k, p) for k, p in enumerate(shares)]).alias("q"))
