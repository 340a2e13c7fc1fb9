"""Intervals of the models and of their ensemble, and R2 of walk-forward, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.operators import forecast as M

SERIES = {
    "line": [1.0, 2.0, 4.0, 4.5, 6.0, 7.5, 8.0], "down": [9.0, 5.0, 3.0, 1.0, 0.5], "flat": [3.0] * 6, "sparse": [0.0] * 8 + [5.0, 0.0, 0.0, 2.0, 0.0, 0.0], "one demand": [0.0] * 9 + [4.0],
    "zeros": [0.0] * 6, "two": [1.0, 5.0], "one": [7.0],
}


def smooth(v, a):
    out = [v[0]]
    for x in v[1:]:
        out.append(a * x + (1 - a) * out[-1])
    return out


def plain(name, v, steps):
    """(predictions, deviation) of one model."""
    n, x = len(v), np.arange(len(v))
    if name in ("linear_regression", "ridge"):
        if n < 2:
            return [v[0]] * steps, 0.0
        sxx = float(((x - x.mean()) ** 2).sum())
        slope = float(((x - x.mean()) * (np.array(v) - np.mean(v))).sum()) / (sxx + (name == "ridge"))
        start = np.mean(v) - slope * x.mean()
        fit = start + slope * x
        if name == "ridge":
            fit = np.maximum(0, fit)
        return [max(0.0, start + slope * (n + i)) for i in range(steps)], math.sqrt(((np.array(v) - fit) ** 2).sum() / max(n - 2, 1))
    if name == "exponential_smoothing":
        s = smooth(v, 0.3)
        trend = (s[-1] - s[max(0, n - 5)]) / min(5, n)
        return [max(0.0, s[-1] + trend * (i + 1)) for i in range(steps)], math.sqrt(sum((a - b) ** 2 for a, b in zip(v, s, strict=True)) / n)
    demands, gaps, last = [], [], -1
    for i, y in enumerate(v):
        if y > 0:
            demands.append(y)
            gaps.append(i - last)
            last = i
    if not demands:
        return [0.0] * steps, 0.0
    level = smooth(demands, 0.1)[-1]
    value = level / smooth(gaps, 0.1)[-1]
    spread = math.sqrt(sum((y - level) ** 2 for y in demands) / len(demands)) if len(demands) > 1 else level / 2
    return [value * (0.95 if name == "sba" else 1)] * steps, spread


@pytest.mark.parametrize("name", list(SERIES))
def test_ensemble_with_intervals(spark, name):
    v, steps = SERIES[name], 4
    names = M.SPARSE if sum(y == 0 for y in v) / len(v) > 0.7 else M.DENSE
    each = [plain(m, v, steps) for m in names]
    mean = [sum(p[i] for p, _ in each) / 3 for i in range(steps)]
    at = {m: plain("croston" if m == "sba" else m, v, steps) for m in names}
    low = [min(max(0.0, p[i] - 1.96 * d * math.sqrt(i + 1)) for p, d in at.values()) for i in range(steps)]
    high = [max(p[i] + 1.96 * d * math.sqrt(i + 1) for p, d in at.values()) for i in range(steps)]
    r = spark.createDataFrame([(v,)], "v array<double>").select(M.ensemble(F.col("v"), steps).alias("p"), M.ensemble_intervals(F.col("v"), steps).alias("c")).first()
    assert np.allclose(r.p, mean) and np.allclose([c.low for c in r.c], low) and np.allclose([c.high for c in r.c], high)


def test_r2_of_walk_forward(spark):
    rows = [("line", SERIES["line"]), ("sparse", SERIES["sparse"]), ("flat", SERIES["flat"])]
    got = {r.k: r.r2 for r in M.walk_forward(spark.createDataFrame(rows, "k string, values array<double>"), ("linear_regression",)).collect()}
    for k, v in rows:
        first = max(3, len(v) // 3)
        true = v[first:]
        model = sum((v[s] - plain("linear_regression", v[:s], 1)[0][0]) ** 2 for s in range(first, len(v)))
        sparse = sum(y == 0 for y in true) / len(true) > 0.7
        base = sum((v[s] - v[s - 1]) ** 2 for s in range(first, len(v))) if sparse else sum((y - np.mean(true)) ** 2 for y in true)
        assert abs(got[k] - (max(0.0, 1 - model / base) if base > 0 else 0.0)) < 1e-9
