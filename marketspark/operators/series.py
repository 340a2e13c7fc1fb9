"""Time series: dense calendars, series as arrays, and statistics of arrays as columns.

A series is an array<double>, oldest first. Helpers take and give columns, so one projection serves every key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def dense_daily(df: DataFrame, keys: list[str], day: str, value: Column, start: str, end: str) -> DataFrame:
    """keys, day, value for every day from start to end (zero where a key has no rows): one aggregate, one join."""
    got = df.groupBy(*keys, day).agg(value.alias("value"))
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(day)
    return df.select(*keys).distinct().select(*keys, days).join(got, [*keys, day], "left").withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))


def as_arrays(df: DataFrame, keys: list[str], order: str, value: str, name: str = "values") -> DataFrame:
    """One row a key with its series in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("double").alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda s: s["v"]).alias(name))


def size(v: Column) -> Column:
    return F.size(v)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once however often f uses it, inside further lambdas too."""
    return F.transform(F.array(x), f)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    """0 for an empty series."""
    return F.when(size(v) > 0, total(v) / size(v)).otherwise(0.0)


def squares(v: Column, m: Column) -> Column:
    return bound(m, lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))


def stddev(v: Column) -> Column:
    """Sample standard deviation; 0 below two values."""
    return F.when(size(v) > 1, F.sqrt(squares(v, mean(v)) / (size(v) - 1))).otherwise(0.0)


def slope(v: Column) -> Column:
    """Least-squares slope over the index; 0 below two values."""
    n = size(v)
    x = (n - 1) / 2
    num = bound(mean(v), lambda m: F.aggregate(F.zip_with(v, F.sequence(F.lit(0), n - 1), lambda y, i: (i - x) * (y - m)), F.lit(0.0), lambda a, t: a + t))
    return F.when(n > 1, num / (n * (n * n - 1) / 12.0)).otherwise(0.0)


def co_moment(v: Column) -> Column:
    """Sum of the products of the deviations of index and value, updated value by value as SQL's regr_slope does; 0 for none."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("c"))

    def step(a: Column, y: Column) -> Column:
        n, dx = a["n"] + 1, a["n"] - a["x"]
        my = a["y"] + (y - a["y"]) / n
        return F.struct(n.alias("n"), (a["x"] + dx / n).alias("x"), my.alias("y"), (a["c"] + dx * (y - my)).alias("c"))

    return F.aggregate(v, start, step, lambda a: a["c"])


def intercept(v: Column) -> Column:
    return mean(v) - slope(v) * (size(v) - 1) / 2


def smoothed(v: Column, alpha: float) -> Column:
    """Exponentially smoothed series of the same length."""
    return F.aggregate(
        F.slice(v, 2, F.greatest(size(v) - 1, F.lit(0))), F.slice(v, 1, 1), lambda a, x: F.concat(a, F.array(alpha * x + (1 - alpha) * F.element_at(a, -1)))
    )


def last(v: Column) -> Column:
    return F.try_element_at(v, F.lit(-1))


def ewma(v: Column, window: int) -> Column:
    """Exponentially weighted mean with alpha 2 / (window + 1); 0 for an empty series."""
    a = F.lit(2.0) / (F.least(F.lit(window), size(v)) + 1)
    return F.when(size(v) > 0, F.aggregate(F.slice(v, 2, F.greatest(size(v) - 1, F.lit(0))), F.try_element_at(v, F.lit(1)), lambda s, x: a * x + (1 - a) * s)).otherwise(0.0)


def volatility(v: Column) -> Column:
    m = mean(v)
    return F.when((size(v) > 1) & (F.abs(m) > 1e-10), stddev(v) / F.abs(m)).otherwise(0.0)


def momentum(v: Column) -> Column:
    """Mean of the second half minus mean of the first; 0 below three values."""
    mid = F.floor(size(v) / 2).cast("int")
    return F.when(size(v) > 2, mean(F.slice(v, mid + 1, size(v) - mid)) - mean(F.slice(v, 1, mid))).otherwise(0.0)


def growth_rate(v: Column) -> Column:
    first = F.try_element_at(v, F.lit(1))
    return F.when((size(v) > 1) & (first > 0), F.pow(last(v) / first, 1.0 / (size(v) - 1)) - 1).otherwise(0.0)


def stability(v: Column) -> Column:
    return F.when(size(v) > 1, clamp(1 - volatility(v))).otherwise(1.0)


def seasonality(v: Column, period: int) -> Column:
    """Spread of the period's means against the spread of all values, 0 to 1; 0 below two periods."""
    m = mean(v)
    groups = [F.filter(F.transform(F.sequence(F.lit(k), F.greatest(size(v) - 1, F.lit(k)), F.lit(period)), lambda i: F.try_element_at(v, i + 1)), lambda x: x.isNotNull()) for k in range(period)]
    between = sum(((mean(g) - m) * (mean(g) - m) for g in groups), F.lit(0.0)) / period
    var = squares(v, m) / size(v)
    return F.when((size(v) >= 2 * period) & (F.abs(m) > 1e-10) & (var > 0), clamp(F.sqrt(between / var))).otherwise(0.0)


def t_value(df: Column) -> Column:
    z = 1.96
    return F.when(df >= 30, F.lit(z)).otherwise(z * (1 + (z * z + 1) / (4 * df)))


def interval(v: Column) -> Column:
    """struct<lo, hi> around the mean; (v, v) for one value, (0, 0) for none."""
    m, s = mean(v), t_value(size(v) - 1) * stddev(v)
    one = F.coalesce(F.try_element_at(v, F.lit(1)), F.lit(0.0))
    return F.when(size(v) > 1, F.struct((m - s).alias("lo"), (m + s).alias("hi"))).otherwise(F.struct(one.alias("lo"), one.alias("hi")))


def direction(s: Column, threshold: float) -> Column:
    return F.when(s > threshold, "up").when(s < -threshold, "down").otherwise("stable")
