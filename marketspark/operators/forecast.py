"""Forecast models as columns over array series, their ensemble, walk-forward evaluation and selection.

Each model maps a series column and a number of steps to array<double>, never below 0. An empty series forecasts 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.operators import series as S


def _steps(n: int, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.greatest(F.lit(0.0), f(i)))


def _line(v: Column) -> Column:
    return F.struct(S.intercept(v).alias("start"), S.slope(v).alias("slope"))


def linear(v: Column, steps: int) -> Column:
    n = S.size(v)
    one = F.coalesce(F.try_element_at(v, F.lit(1)), F.lit(0.0))
    line = S.bound(_line(v), lambda x: _steps(steps, lambda i: x["start"] + x["slope"] * (n - 1 + i)))
    return F.when(n > 1, line).otherwise(F.array_repeat(one, steps))


def moving_average(v: Column, steps: int, window: int = 3) -> Column:
    """Each step is the mean of the `window` values before it, forecasts included."""
    start = F.struct(F.slice(v, -window, window).alias("w"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, _: Column) -> Column:
        p = F.greatest(F.lit(0.0), S.total(a["w"]) / window)
        return F.struct(F.concat(F.slice(a["w"], 2, window - 1), F.array(p)).alias("w"), F.concat(a["out"], F.array(p)).alias("out"))

    long = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["out"])
    return F.when(S.size(v) >= window, long).otherwise(F.array_repeat(F.greatest(F.lit(0.0), S.mean(v)), steps))


def exponential(v: Column, steps: int, alpha: float = 0.3) -> Column:
    n = S.size(v)
    trend = lambda s: F.struct(S.last(s).alias("last"), ((S.last(s) - F.try_element_at(s, F.greatest(n - 4, F.lit(1)))) / F.least(F.lit(5), n)).alias("trend"))
    line = S.bound(S.bound(S.smoothed(v, alpha), trend), lambda x: _steps(steps, lambda i: x["last"] + x["trend"] * i))
    return F.when(n > 0, line).otherwise(F.array_repeat(F.lit(0.0), steps))


def endpoints(v: Column, steps: int) -> Column:
    n = S.size(v)
    trend = F.when(n > 1, (S.last(v) - F.try_element_at(v, F.lit(1))) / (n - 1)).otherwise(0.0)
    return F.when(n > 0, _steps(steps, lambda i: S.last(v) + trend * i)).otherwise(F.array_repeat(F.lit(0.0), steps))


def naive_trend(v: Column, steps: int) -> Column:
    """Last value plus the slope a step (may fall below 0)."""
    return S.bound(S.slope(v), lambda b: F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.coalesce(S.last(v), F.lit(0.0)) + b * i))


def croston(v: Column, steps: int, alpha: float = 0.1, correction: float = 1.0) -> Column:
    """Smoothed size of demands by smoothed gap between them (the first gap runs from the start)."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(S.size(v), F.lit(1))), lambda i: F.coalesce(F.try_element_at(v, i), F.lit(0.0)) > 0)
    sizes = F.filter(v, lambda x: x > 0)
    gaps = F.transform(F.zip_with(at, F.concat(F.array(F.lit(0)), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))), lambda a, b: a - b), lambda x: x.cast("double"))
    value = S.last(S.smoothed(sizes, alpha)) / S.last(S.smoothed(gaps, alpha))
    return F.array_repeat(F.greatest(F.lit(0.0), F.coalesce(value * correction, F.lit(0.0))), steps)


def sba(v: Column, steps: int, alpha: float = 0.1) -> Column:
    return croston(v, steps, alpha, 1 - alpha / 2)


def ridge_line(v: Column, alpha: float = 1.0) -> tuple[Column, Column]:
    """Slope and intercept of a ridge regression on the index, the intercept being free: the closed form, since the centred
    index and the intercept don't mix."""
    n = S.size(v)
    slope = S.slope(v) * (n * (n * n - 1) / 12.0) / (n * (n * n - 1) / 12.0 + alpha)
    return slope, S.mean(v) - slope * (n - 1) / 2


def _ridge(v: Column) -> Column:
    slope, start = ridge_line(v)
    return F.struct(start.alias("start"), slope.alias("slope"))


def ridge_steps(v: Column, steps: int) -> Column:
    n = S.size(v)
    one = F.coalesce(F.try_element_at(v, F.lit(1)), F.lit(0.0))
    line = S.bound(_ridge(v), lambda x: _steps(steps, lambda i: x["start"] + x["slope"] * (n - 1 + i)))
    return F.when(n > 1, line).otherwise(F.array_repeat(one, steps))


MODELS: dict[str, Callable[[Column, int], Column]] = {"linear_regression": linear, "moving_average": moving_average, "exponential_smoothing": exponential, "heuristic": endpoints, "croston": croston, "sba": sba, "ridge": ridge_steps}
DENSE, SPARSE = ("linear_regression", "ridge", "exponential_smoothing"), ("croston", "sba", "ridge")
#: Fixed value: deviations on either side of a forecast.
WIDTH = 1.96


def _rms(parts: Column, by: Column) -> Column:
    """Root of the sum of squares over `by`, 1 at least."""
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x * x) / F.greatest(by, F.lit(1)))


def _against(v: Column, fitted: Callable[[Column], Column]) -> Column:
    return F.transform(v, lambda x, i: x - fitted(i))


def deviation(model: str, v: Column) -> Column:
    """What a model's interval is wide by at the first step: the spread of its residuals, of demands for the intermittent ones."""
    n = S.size(v)
    if model == "linear_regression":
        return S.bound(_line(v), lambda x: _rms(_against(v, lambda i: x["start"] + x["slope"] * i), n - 2))
    if model == "ridge":
        wide = S.bound(_ridge(v), lambda x: _rms(_against(v, lambda i: F.greatest(F.lit(0.0), x["start"] + x["slope"] * i)), n - 2))
        return F.when(n > 1, wide).otherwise(0.0)
    if model == "exponential_smoothing":
        s = S.smoothed(v, 0.3)
        return _rms(F.zip_with(v, s, lambda a, b: a - b), n)
    if model == "heuristic":
        return S.bound(S.mean(v), lambda m: _rms(_against(v, lambda i: m), n))
    if model == "moving_average":
        w = F.slice(v, -3, 3)
        return F.sqrt(S.squares(w, S.mean(w))) / 3
    sizes = F.filter(v, lambda x: x > 0)
    level = F.coalesce(S.last(S.smoothed(sizes, 0.1)), F.lit(0.0))
    return F.when(F.size(sizes) > 1, F.sqrt(S.squares(sizes, level) / F.size(sizes))).otherwise(0.5 * level)


def intervals(model: str, v: Column, steps: int) -> Column:
    """array<struct<low, high>> of each step: WIDTH deviations times the root of the step, not below 0. Of a moving average
    over fewer than three values, a fifth on either side; of one value's regressions, the value."""
    p, wide = MODELS["croston" if model == "sba" else model](v, steps), deviation(model, v) * WIDTH
    out = S.bound(wide, lambda w: F.transform(p, lambda x, i: F.struct(F.greatest(F.lit(0.0), x - w * F.sqrt(i + 1.0)).alias("low"), (x + w * F.sqrt(i + 1.0)).alias("high"))))
    share = lambda d: F.transform(p, lambda x: F.struct((x * (1 - d)).alias("low"), (x * (1 + d)).alias("high")))
    if model == "moving_average":
        return F.when(S.size(v) >= 3, out).otherwise(share(0.2))
    return F.when(S.size(v) > 1, out).otherwise(share(0.0)) if model in ("linear_regression", "ridge") else out


def _sparse(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x == 0)) / S.size(v) > 0.7


def ensemble(v: Column, steps: int) -> Column:
    """Mean of three models at each step; series with more than 70 % zeros take the sparse ones."""

    def of(names: tuple[str, ...]) -> Column:
        a, b, c = (MODELS[n](v, steps) for n in names)
        return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), c, lambda x, y: (x + y) / 3)

    return F.when(_sparse(v), of(SPARSE)).otherwise(of(DENSE))


def ensemble_intervals(v: Column, steps: int) -> Column:
    """array<struct<low, high>>: of each step the widest that any of the ensemble's models gives."""

    def of(names: tuple[str, ...]) -> Column:
        a, b, c = (intervals(n, v, steps) for n in names)
        both = lambda x, y: F.struct(F.least(x["low"], y["low"]).alias("low"), F.greatest(x["high"], y["high"]).alias("high"))
        return F.zip_with(F.zip_with(a, b, both), c, both)

    return F.when(_sparse(v), of(SPARSE)).otherwise(of(DENSE))


def with_forecasts(df: DataFrame, models: tuple[str, ...], steps: int, values: str = "values") -> DataFrame:
    """df's keys with model, step, prediction: a row a model and step."""
    keys = [c for c in df.columns if c != values]
    each = F.array(*[F.struct(F.lit(m).alias("model"), MODELS[m](F.col(values), steps).alias("p")) for m in models])
    return df.select(*keys, F.explode(each).alias("m")).select(*keys, F.col("m.model").alias("model"), F.posexplode("m.p").alias("step", "prediction"))


def ridge(df: DataFrame, key: str, steps: int, values: str = "values") -> DataFrame:
    """key, step, prediction of a ridge regression on the time index, intercept free."""
    return df.select(key, F.posexplode(ridge_steps(F.coalesce(F.col(values), F.array().cast("array<double>")), steps)).alias("step", "prediction"))


def walk_forward(df: DataFrame, models: tuple[str, ...], values: str = "values") -> DataFrame:
    """df's keys, model, n, mae, rmse, mape, negatives, r2: one step ahead from every split after a third of the series.

    r2 is against the mean of what came; where more than 70 % of it is zero, against the value before each; 0 at least,
    and 0 where that has no error at all."""
    keys = [c for c in df.columns if c != values]
    n = F.size(values)
    first = F.greatest(F.lit(3), F.floor(n / 3).cast("int"))
    cuts = df.where(n >= 4).select(*keys, values, F.explode(F.sequence(first, n - 1)).alias("split"))
    rows = cuts.select(*keys, F.element_at(values, F.col("split") + 1).alias("actual"), F.element_at(values, F.col("split")).alias("before"), F.slice(F.col(values), F.lit(1), F.col("split")).alias("train"))
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.element_at(MODELS[m](F.col("train"), 1), 1).alias("p")) for m in models])
    rows = rows.select(*keys, "actual", "before", F.explode(each).alias("m")).withColumn("e", F.abs(F.col("actual") - F.col("m.p")))
    left, naive = F.sum(F.col("e") * F.col("e")), F.sum((F.col("actual") - F.col("before")) * (F.col("actual") - F.col("before")))
    spread = F.var_pop("actual") * F.count(F.lit(1))
    sparse = F.count_if(F.col("actual") == 0) / F.count(F.lit(1)) > 0.7
    r2 = F.when(sparse, F.when(naive > 0, F.greatest(F.lit(0.0), 1 - left / naive)).otherwise(0.0)).otherwise(F.when(spread > 0, F.greatest(F.lit(0.0), 1 - left / spread)).otherwise(0.0))
    return rows.groupBy(*keys, F.col("m.model").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), (100 * F.avg(F.col("e") / F.greatest(F.abs("actual"), F.lit(1e-10)))).alias("mape"), F.count_if(F.col("m.p") < 0).alias("negatives"), r2.alias("r2")
    )


def select_model(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The model of least rmse (two more for each negative prediction) for each key, ties by name."""
    cost = F.col("rmse") + 2 * F.col("negatives")
    return scores.groupBy(*keys).agg(F.min_by("model", F.struct(cost, "model")).alias("model"), F.min(cost).alias("cost"))
