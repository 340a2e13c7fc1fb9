"""Exact ranks and quantiles against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.operators import selection as S


def rows():
    rng = random.Random(5)
    out = [("hot", rng.choice([rng.random(), 5.0, rng.gauss(0, 1e6), float(rng.randint(0, 3))])) for _ in range(9000)]
    out += [("one", 7.5), ("two", 1.0), ("two", 2.0), ("same", 3.0), ("same", 3.0), ("same", 3.0), ("none", None), ("nan", float("nan")), ("nan", 4.0), ("wide", -1e300), ("wide", 1e-300), ("wide", 0.0), ("tiny", 5e-324), ("tiny", 0.0)]
    return out


def values():
    by = {}
    for k, v in rows():
        if v is not None and not math.isnan(v):
            by.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in by.items()}


@pytest.mark.parametrize("sort_at", [10_000, 5])
def test_ranks(spark, sort_at, monkeypatch):
    """Sorted at once, or refined over several rounds."""
    monkeypatch.setattr(S, "SORTED", sort_at)
    df = spark.createDataFrame(rows(), "k string, v double").repartition(3)
    got = {r.k: r for r in S.at_ranks(df, ["k"], "v", lambda n: [F.floor(n / 2) + 1, F.lit(1), n, n + 1, F.lit(None)]).collect()}
    want = values()
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k].n, got[k].low, got[k].high) == (len(v), v[0], v[-1])
        assert got[k]["at"] == [v[len(v) // 2], v[0], v[-1], None, None]


def test_quantiles(spark):
    df = spark.createDataFrame(rows(), "k string, v double")
    got = {r.k: r.q for r in S.quantiles(df, ["k"], "v", 0.0, 0.5, 0.95, 0.99, 1.0).collect()}
    for k, v in values().items():
        assert np.allclose(got[k], np.quantile(v, [0.0, 0.5, 0.95, 0.99, 1.0]), rtol=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert S.quantiles(df, ["k"], "v", 0.5).count() == 0


def test_no_key_is_collected(spark):
    """Aggregates that gather a key's values don't occur in any plan of the selection but for the wanted ranks."""
    df = spark.createDataFrame(rows(), "k string, v double")
    plan = S.quantiles(df, ["k"], "v", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_list(_v" not in plan
