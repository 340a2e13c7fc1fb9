"""Series, features, forecasts and trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketspark.operators import forecast as M
from marketspark.operators import series as S
from marketspark.plans.registry import query
from marketspark.sources.tables import change_events, pricing

START, END = "2024-01-01", "2024-01-30"
#: Weights of the event kinds in the composite activity signal.
WEIGHT = {"purchase": 3.0, "signup": 1.0, "view": 0.5, "click": 0.1, "error": 0.1}
_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHT.items()) + " END"
_DAYS = f"days AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS day)"
_COMPOSITE = f"{_DAYS}, k AS (SELECT DISTINCT competitor_id FROM changes), s AS (SELECT k.competitor_id, d.day, CAST(d.day - DATE '{START}' AS DOUBLE) AS i, CAST(COALESCE(c.v, 0) AS DOUBLE) AS v FROM k CROSS JOIN days d LEFT JOIN (SELECT competitor_id, day, sum({_CASE}) AS v FROM changes GROUP BY 1, 2) c ON c.competitor_id = k.competitor_id AND c.day = d.day)"


def composite(spark, d):
    # Exact sums: a day's value doesn't depend on the order of its events.
    w = F.coalesce(*[F.when(F.col("kind") == k, F.lit(str(v)).cast("decimal(2,1)")) for k, v in WEIGHT.items()])
    return S.dense_daily(change_events(spark, d), ["competitor_id"], "day", F.sum(w), START, END)


def composite_arrays(spark, d):
    return S.as_arrays(composite(spark, d), ["competitor_id"], "day", "value")


@query("growth_forecast_linear", f"""
WITH {_COMPOSITE}, r AS (SELECT competitor_id, regr_slope(v, i) b, regr_intercept(v, i) a, avg(v) FILTER (i >= 23) r FROM s GROUP BY 1),
f AS (SELECT competitor_id, b, r, (SELECT avg(greatest(0, a + b * (30 + g))) FROM generate_series(0, 6) t(g)) f FROM r), x AS (SELECT *, (f - r) / greatest(r, 0.1) q FROM f)
SELECT competitor_id, round(b, 6) AS slope, round(f, 4) AS forecast, round(r, 4) AS recent, CASE WHEN q > 0.15 THEN 'accelerating' WHEN q > 0 THEN 'growing' WHEN q > -0.15 THEN 'slowing' ELSE 'declining' END AS level,
round(greatest(0, least(100, 50 + 200 * q)), 2) AS score FROM x""", "changes")
def _(spark, d):
    s = composite(spark, d).withColumn("i", F.datediff("day", F.lit(START)).cast("double"))
    g = s.groupBy("competitor_id").agg(F.regr_slope("value", "i").alias("b"), F.regr_intercept("value", "i").alias("a"), F.avg(F.when(F.col("i") >= 23, F.col("value"))).alias("r"))
    f = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.greatest(F.lit(0.0), F.col("a") + F.col("b") * (30 + k))), F.lit(0.0), lambda a, x: a + x) / 7
    q = F.col("q")
    level = F.when(q > 0.15, "accelerating").when(q > 0, "growing").when(q > -0.15, "slowing").otherwise("declining")
    return g.withColumn("f", f).withColumn("q", (F.col("f") - F.col("r")) / F.greatest(F.col("r"), F.lit(0.1))).select("competitor_id", F.round("b", 6).alias("slope"), F.round("f", 4).alias("forecast"), F.round("r", 4).alias("recent"), level.alias("level"), F.round(S.clamp(50 + 200 * q, 0.0, 100.0), 2).alias("score"))


@query("daily_series_dense", f"WITH {_DAYS}, k AS (SELECT DISTINCT kind FROM changes) SELECT k.kind, d.day, CAST(count(c.event_id) AS DOUBLE) AS value FROM k CROSS JOIN days d LEFT JOIN changes c ON c.kind = k.kind AND c.day = d.day GROUP BY 1, 2", "changes")
def _(spark, d):
    return S.dense_daily(change_events(spark, d), ["kind"], "day", F.count("*"), START, END)


@query("daily_metric_series", "SELECT category, day, round(avg(price), 7) AS mean, min(price) AS low, max(price) AS high, round(avg(discount), 6) AS discount, count(*) AS n FROM pricing WHERE day >= DATE '1997-01-01' AND day < DATE '1998-01-01' GROUP BY 1, 2", "pricing")
def _(spark, d):
    p = pricing(spark, d).where((F.col("day") >= F.lit("1997-01-01").cast("date")) & (F.col("day") < F.lit("1998-01-01").cast("date")))
    return p.groupBy("category", "day").agg(F.round(F.avg("price"), 7).alias("mean"), F.min("price").alias("low"), F.max("price").alias("high"), F.round(F.avg("discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("value_series", "SELECT service_id, count(*) AS n, arg_min(price, (day, order_id, line)) AS first, arg_max(price, (day, order_id, line)) AS last FROM pricing GROUP BY 1", "pricing")
def _(spark, d):
    at = F.struct("day", "order_id", "line")
    return pricing(spark, d).groupBy("service_id").agg(F.count("*").alias("n"), F.min_by("price", at).alias("first"), F.max_by("price", at).alias("last"))


@query("rolling_features", f"""
WITH {_COMPOSITE} SELECT competitor_id, day, round(avg(v) OVER (PARTITION BY competitor_id ORDER BY day ROWS 2 PRECEDING), 4) AS ma3, round(sum(v) OVER w, 4) AS sum7, round(avg(v) OVER w, 4) AS mean7, round(COALESCE(stddev_samp(v) OVER w, 0), 4) AS sd7,
round(COALESCE(lag(v, 1) OVER o, first_value(v) OVER o), 4) AS lag1, round(COALESCE(lag(v, 7) OVER o, first_value(v) OVER o), 4) AS lag7, round(sin(2 * pi() * (isodow(day) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(day) - 1) / 7), 6) AS dow_cos
FROM s WINDOW o AS (PARTITION BY competitor_id ORDER BY day), w AS (PARTITION BY competitor_id ORDER BY day ROWS 6 PRECEDING)""", "changes")
def _(spark, d):
    o = Window.partitionBy("competitor_id").orderBy("day")
    w, v = o.rowsBetween(-6, 0), F.col("value")
    turn = 2 * F.pi() * F.weekday("day") / 7
    r = lambda c, n=4: F.round(c, n)
    return composite(spark, d).select(
        "competitor_id", "day", r(F.avg(v).over(o.rowsBetween(-2, 0))).alias("ma3"), r(F.sum(v).over(w)).alias("sum7"), r(F.avg(v).over(w)).alias("mean7"), r(F.coalesce(F.stddev_samp(v).over(w), F.lit(0.0))).alias("sd7"),
        r(F.coalesce(F.lag(v, 1).over(o), F.first(v).over(o))).alias("lag1"), r(F.coalesce(F.lag(v, 7).over(o), F.first(v).over(o))).alias("lag7"), r(F.sin(turn), 6).alias("dow_sin"), r(F.cos(turn), 6).alias("dow_cos"),
    )


@query("week_over_week", f"""
WITH {_COMPOSITE} SELECT competitor_id, round(sum(v) FILTER (i >= 23), 4) AS recent, round(sum(v) FILTER (i >= 16 AND i < 23), 4) AS previous, round(sum(v) FILTER (i >= 23) / greatest(sum(v) FILTER (i >= 16 AND i < 23), 1), 6) AS ratio,
round(sum(v) FILTER (i >= 23) - sum(v) FILTER (i < 7), 4) AS acceleration, round(avg(v) FILTER (i >= 15) - avg(v) FILTER (i < 15), 6) AS momentum FROM s GROUP BY 1""", "changes")
def _(spark, d):
    v = F.col("values")
    part = lambda a, n: S.total(F.slice(v, a, n))
    return composite_arrays(spark, d).select("competitor_id", F.round(part(24, 7), 4).alias("recent"), F.round(part(17, 7), 4).alias("previous"), F.round(part(24, 7) / F.greatest(part(17, 7), F.lit(1.0)), 6).alias("ratio"), F.round(part(24, 7) - part(1, 7), 4).alias("acceleration"), F.round(S.momentum(v), 6).alias("momentum"))


@query("growth_velocity", f"""
WITH {_COMPOSITE}, h AS (SELECT competitor_id, avg(v) FILTER (i >= 15) - avg(v) FILTER (i < 15) v30, avg(v) FILTER (i >= 23) - avg(v) FILTER (i >= 16 AND i < 23) v14 FROM s GROUP BY 1)
SELECT competitor_id, round(v30, 6) AS velocity_30, round(v14, 6) AS velocity_14, CASE WHEN 0.6 * v30 + 0.4 * v14 > 0.05 THEN 'up' WHEN 0.6 * v30 + 0.4 * v14 < -0.05 THEN 'down' ELSE 'stable' END AS direction FROM h""", "changes")
def _(spark, d):
    v = F.col("values")
    a, b = S.mean(F.slice(v, 16, 15)) - S.mean(F.slice(v, 1, 15)), S.mean(F.slice(v, 24, 7)) - S.mean(F.slice(v, 17, 7))
    return composite_arrays(spark, d).withColumns({"a": a, "b": b}).select("competitor_id", F.round("a", 6).alias("velocity_30"), F.round("b", 6).alias("velocity_14"), S.direction(0.6 * F.col("a") + 0.4 * F.col("b"), 0.05).alias("direction"))


@query("trend_direction_by_category", """
WITH m AS (SELECT category, date_trunc('month', day) mo, avg(price) v FROM pricing GROUP BY 1, 2), x AS (SELECT category, v, row_number() OVER (PARTITION BY category ORDER BY mo) - 1 i FROM m), r AS (SELECT category, regr_slope(v, i) b, count(*) n FROM x GROUP BY 1)
SELECT category, n AS months, round(COALESCE(b, 0), 4) AS slope, CASE WHEN COALESCE(b, 0) > 0.5 THEN 'up' WHEN COALESCE(b, 0) < -0.5 THEN 'down' ELSE 'stable' END AS direction FROM r""", "pricing")
def _(spark, d):
    m = pricing(spark, d).groupBy("category", F.trunc("day", "month").alias("mo")).agg(F.avg("price").alias("v"))
    x = m.withColumn("i", F.row_number().over(Window.partitionBy("category").orderBy("mo")) - 1)
    b = F.coalesce(F.regr_slope("v", "i"), F.lit(0.0))
    return x.groupBy("category").agg(F.count("*").alias("months"), b.alias("b")).select("category", "months", F.round("b", 4).alias("slope"), S.direction(F.col("b"), 0.5).alias("direction"))


@query("trend_state", f"""
WITH {_COMPOSITE}, h AS (SELECT competitor_id, avg(v) FILTER (i >= 23) - avg(v) FILTER (i >= 16 AND i < 23) m, regr_slope(v, i) b FROM s GROUP BY 1)
SELECT competitor_id, CASE WHEN m > 0.01 AND b >= 0 THEN 'growing' WHEN m > 0.01 THEN 'recovering' WHEN m < -0.01 AND b > 0 THEN 'cooling' WHEN m < -0.01 THEN 'declining' ELSE 'stable' END AS state FROM h""", "changes")
def _(spark, d):
    v = F.col("values")
    m, b = S.mean(F.slice(v, 24, 7)) - S.mean(F.slice(v, 17, 7)), S.co_moment(v)  # has the slope's sign
    state = F.when((F.col("m") > 0.01) & (F.col("b") >= 0), "growing").when(F.col("m") > 0.01, "recovering").when((F.col("m") < -0.01) & (F.col("b") > 0), "cooling").when(F.col("m") < -0.01, "declining").otherwise("stable")
    return composite_arrays(spark, d).withColumns({"m": m, "b": b}).select("competitor_id", state.alias("state"))


@query("seasonality_strength", f"""
WITH {_COMPOSITE}, o AS (SELECT competitor_id, avg(v) m, var_pop(v) p FROM s GROUP BY 1), g AS (SELECT competitor_id, CAST(i AS INT) % 7 k, avg(v) gm FROM s GROUP BY 1, 2)
SELECT competitor_id, round(CASE WHEN abs(m) <= 1e-10 OR p <= 0 THEN 0 ELSE greatest(0, least(1, sqrt((sum((gm - m) * (gm - m)) / 7) / p))) END, 6) AS strength FROM o JOIN g USING (competitor_id) GROUP BY 1, m, p""", "changes")
def _(spark, d):
    return composite_arrays(spark, d).select("competitor_id", F.round(S.seasonality(F.col("values"), 7), 6).alias("strength"))


@query("series_statistics", f"""
WITH {_COMPOSITE}, a AS (SELECT competitor_id, list(v ORDER BY i) l, avg(v) m, stddev_samp(v) sd FROM s GROUP BY 1)
SELECT competitor_id, round(CASE WHEN abs(m) > 1e-10 THEN sd / abs(m) ELSE 0 END, 6) AS volatility, round(greatest(0, least(1, 1 - CASE WHEN abs(m) > 1e-10 THEN sd / abs(m) ELSE 0 END)), 6) AS stability,
round(list_reduce(l, lambda acc, x: 0.5 * x + 0.5 * acc), 6) AS ewma3, round(CASE WHEN l[1] > 0 THEN pow(l[30] / l[1], 1.0 / 29) - 1 ELSE 0 END, 6) AS growth, round(m - 1.96 * (1 + (1.96 * 1.96 + 1) / (4 * 29)) * sd, 6) AS lo, round(m + 1.96 * (1 + (1.96 * 1.96 + 1) / (4 * 29)) * sd, 6) AS hi FROM a""", "changes")
def _(spark, d):
    v = F.col("values")
    return composite_arrays(spark, d).select("competitor_id", F.round(S.volatility(v), 6).alias("volatility"), F.round(S.stability(v), 6).alias("stability"), F.round(S.ewma(v, 3), 6).alias("ewma3"), F.round(S.growth_rate(v), 6).alias("growth"), F.round(S.interval(v)["lo"], 6).alias("lo"), F.round(S.interval(v)["hi"], 6).alias("hi"))


@query("exp_smoothing_forecast", f"""
WITH {_COMPOSITE}, a AS (SELECT competitor_id, list(v ORDER BY i) l FROM s GROUP BY 1), e AS (SELECT competitor_id, list_reduce(l, lambda acc, x: 0.3 * x + 0.7 * acc) z, list_reduce(l[1:26], lambda acc, x: 0.3 * x + 0.7 * acc) y FROM a)
SELECT competitor_id, g AS step, round(greatest(0, z + (z - y) / 5 * (g + 1)), 6) AS prediction FROM e, (SELECT CAST(unnest(range(7)) AS INT) g)""", "changes")
def _(spark, d):
    return M.with_forecasts(composite_arrays(spark, d), ("exponential_smoothing",), 7).select("competitor_id", "step", F.round("prediction", 6).alias("prediction"))


@query("clipped_linear_forecast", f"""
WITH {_COMPOSITE}, r AS (SELECT competitor_id, regr_slope(v, i) b, regr_intercept(v, i) a FROM s GROUP BY 1) SELECT competitor_id, g AS step, round(greatest(0, a + b * (30 + g)), 6) AS prediction FROM r, (SELECT CAST(unnest(range(7)) AS INT) g)""", "changes")
def _(spark, d):
    return M.with_forecasts(composite_arrays(spark, d), ("linear_regression",), 7).select("competitor_id", "step", F.round("prediction", 6).alias("prediction"))


@query("endpoint_heuristic", f"""
WITH {_COMPOSITE}, a AS (SELECT competitor_id, list(v ORDER BY i) l FROM s GROUP BY 1) SELECT competitor_id, g AS step, round(greatest(0, l[30] + (l[30] - l[1]) / 29 * (g + 1)), 6) AS prediction FROM a, (SELECT CAST(unnest(range(7)) AS INT) g)""", "changes")
def _(spark, d):
    return M.with_forecasts(composite_arrays(spark, d), ("heuristic",), 7).select("competitor_id", "step", F.round("prediction", 6).alias("prediction"))


@query("moving_average_forecast", f"""
WITH {_COMPOSITE}, a AS (SELECT competitor_id, list(v ORDER BY i) l FROM s GROUP BY 1), x AS (SELECT competitor_id, l[28] p, l[29] q, l[30] r FROM a), y AS (SELECT *, (p + q + r) / 3 a1 FROM x), z AS (SELECT *, (q + r + a1) / 3 a2 FROM y), w AS (SELECT *, (r + a1 + a2) / 3 a3 FROM z)
SELECT competitor_id, round(a1, 6) AS step1, round(a2, 6) AS step2, round(a3, 6) AS step3 FROM w""", "changes")
def _(spark, d):
    p = M.moving_average(F.col("values"), 3)
    return composite_arrays(spark, d).withColumn("p", p).select("competitor_id", *[F.round(F.element_at("p", k), 6).alias(f"step{k}") for k in (1, 2, 3)])


@query("croston_sba")
def _(spark, d):
    v = F.col("values")
    return composite_arrays(spark, d).select("competitor_id", F.round(F.element_at(M.croston(v, 1), 1), 6).alias("croston"), F.round(F.element_at(M.sba(v, 1), 1), 6).alias("sba"))


@query("ridge_forecast", f"""
WITH {_COMPOSITE}, c AS (SELECT competitor_id, avg(v) m, sum((i - 14.5) * v) xy, sum(i * i) - 30 * 14.5 * 14.5 xx FROM s GROUP BY 1), b AS (SELECT competitor_id, m, xy / (xx + 1) w FROM c)
SELECT competitor_id, g AS step, round(greatest(0, m - w * 14.5 + w * (30 + g)), 6) AS prediction FROM b, (SELECT CAST(unnest(range(7)) AS INT) g)""", "changes")
def _(spark, d):
    return M.ridge(composite_arrays(spark, d), "competitor_id", 7).withColumn("prediction", F.round("prediction", 6))


@query("ensemble_forecast")
def _(spark, d):
    """Mean of three models with the widest of their intervals."""
    v = F.col("values")
    both = F.zip_with(M.ensemble(v, 7), M.ensemble_intervals(v, 7), lambda p, c: F.struct(p.alias("prediction"), c["low"].alias("low"), c["high"].alias("high")))
    return composite_arrays(spark, d).select("competitor_id", F.posexplode(both).alias("step", "x")).select("competitor_id", "step", "x.*")


@query("walk_forward_eval")
def _(spark, d):
    s = S.as_arrays(S.dense_daily(change_events(spark, d), ["kind"], "day", F.count("*"), START, END), ["kind"], "day", "value")
    return M.walk_forward(s, ("linear_regression", "moving_average", "exponential_smoothing", "heuristic"))


@query("model_selection")
def _(spark, d):
    s = S.as_arrays(S.dense_daily(change_events(spark, d), ["kind"], "day", F.count("*"), START, END), ["kind"], "day", "value")
    return M.select_model(M.walk_forward(s, ("linear_regression", "moving_average", "exponential_smoothing", "heuristic")), ["kind"])


@query("price_trajectory", """
WITH m AS (SELECT category, avg(price) g FROM pricing GROUP BY 1), o AS (SELECT competitor_id, category, avg(price) p, COALESCE(stddev_samp(price), 0) s FROM pricing GROUP BY 1, 2)
SELECT competitor_id, category, h AS horizon, round(p + (g - p) * (1 - exp(-h / 90.0)), 4) AS predicted, round(1.96 * s * sqrt(h / 30.0), 4) AS band FROM o JOIN m USING (category), (SELECT unnest([30, 90, 180]) h)""", "pricing")
def _(spark, d):
    p = pricing(spark, d)
    m, o = p.groupBy("category").agg(F.avg("price").alias("g")), p.groupBy("competitor_id", "category").agg(F.avg("price").alias("p"), F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("s"))
    h = F.col("horizon")
    rows = o.join(m, "category").withColumn("horizon", F.explode(F.array(F.lit(30), F.lit(90), F.lit(180))))
    return rows.select("competitor_id", "category", "horizon", F.round(F.col("p") + (F.col("g") - F.col("p")) * (1 - F.exp(-h / 90.0)), 4).alias("predicted"), F.round(1.96 * F.col("s") * F.sqrt(h / 30.0), 4).alias("band"))


@query("drift", f"""
WITH {_COMPOSITE} SELECT competitor_id, round(avg(v) FILTER (i >= 25), 6) AS recent, round(avg(v) FILTER (i < 25), 6) AS older, abs(avg(v) FILTER (i >= 25) - avg(v) FILTER (i < 25)) > 0.1 AS drifting FROM s GROUP BY 1""", "changes")
def _(spark, d):
    a, b = S.mean(F.slice("values", 26, 5)), S.mean(F.slice("values", 1, 25))
    return composite_arrays(spark, d).withColumns({"a": a, "b": b}).select("competitor_id", F.round("a", 6).alias("recent"), F.round("b", 6).alias("older"), (F.abs(F.col("a") - F.col("b")) > 0.1).alias("drifting"))


@query("backtest_errors", """
WITH p AS (SELECT kind, day, count(*) n FROM changes GROUP BY 1, 2), x AS (SELECT kind, n, avg(n) OVER (PARTITION BY kind ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) f, row_number() OVER (PARTITION BY kind ORDER BY day) r FROM p)
SELECT kind, count(*) AS n, round(avg(abs(n - f)), 6) AS mae, round(sqrt(avg((n - f) * (n - f))), 6) AS rmse, round(100 * avg(abs(n - f) / n), 6) AS mape FROM x WHERE r > 7 GROUP BY 1""", "changes")
def _(spark, d):
    p = change_events(spark, d).groupBy("kind", "day").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy("day")
    x = p.withColumn("f", F.avg("n").over(w.rowsBetween(-7, -1))).withColumn("r", F.row_number().over(w)).where("r > 7").withColumn("e", F.col("n") - F.col("f"))
    return x.groupBy("kind").agg(F.count("*").alias("c"), F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"), F.round(100 * F.avg(F.abs("e") / F.col("n")), 6).alias("mape")).withColumnRenamed("c", "n")
