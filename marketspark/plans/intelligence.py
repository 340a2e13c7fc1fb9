"""Weighted scores, observation quality, the validation pipeline, rule-based findings, explanations and reports."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.series import clamp
from marketspark.plans.registry import VIEWS, query
from marketspark.sources.tables import change_events, collection_logs, competitors, pricing, services, table

# --- inputs a competitor, each fact aggregated before it is joined

VIEWS["inputs"] = """
last AS (SELECT (SELECT max(day) FROM pricing) AS price_day, (SELECT max(day) FROM changes) AS change_day, (SELECT max(day) FROM logs) AS log_day),
inputs AS (SELECT c.competitor_id, c.name, c.nation, c.region, c.enabled, c.balance, COALESCE(s.n, 0) AS svc, COALESCE(s.k, 0) AS src,
  COALESCE(p.n, 0) AS prc, p.mean, p.sd, p.price_age, COALESCE(g.recent, 0) AS chg, COALESCE(g.content, 0) AS cnt, COALESCE(g.kinds, 0) AS soc,
  COALESCE(l.runs, 0) AS runs, COALESCE(l.ok, 0) AS ok, l.log_age
FROM competitors c
LEFT JOIN (SELECT competitor_id, count(*) n, count(DISTINCT brand) k FROM services GROUP BY 1) s USING (competitor_id)
LEFT JOIN (SELECT competitor_id, count(*) n, avg(price) mean, stddev_samp(price) sd,
  date_diff('day', max(day), any_value(price_day)) price_age FROM pricing, last GROUP BY 1) p USING (competitor_id)
LEFT JOIN (SELECT competitor_id, count(*) FILTER (day > change_day - 30) recent, count(*) FILTER (kind IN ('view', 'click')) content,
  count(DISTINCT kind) kinds FROM changes, last GROUP BY 1) g USING (competitor_id)
LEFT JOIN (SELECT competitor_id, count(*) runs, count(*) FILTER (success) ok, date_diff('day', max(day), any_value(log_day)) log_age
  FROM logs, last GROUP BY 1) l USING (competitor_id))"""
BASE = ("competitors", "services", "pricing", "changes", "logs", "inputs")


def inputs(spark, d) -> DataFrame:
    """A row a competitor: counts of services (svc), brands as sources (src), prices (prc), recent changes (chg), content events
    (cnt), kinds of events as channels (soc), runs and successes, and ages of the newest price and run in days."""
    last = pricing(spark, d).agg(F.max("day").alias("price_day"))
    last = last.crossJoin(change_events(spark, d).agg(F.max("day").alias("change_day")))
    last = F.broadcast(last.crossJoin(collection_logs(spark, d).agg(F.max("day").alias("log_day"))))  # one row
    s = services(spark, d).groupBy("competitor_id").agg(F.count("*").alias("svc"), F.count_distinct("brand").alias("src"))
    p = pricing(spark, d).groupBy("competitor_id").agg(F.count("*").alias("prc"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("sd"), F.max("day").alias("pd"))
    g = change_events(spark, d).crossJoin(last).groupBy("competitor_id").agg(
        F.count_if(F.col("day") > F.date_sub("change_day", 30)).alias("chg"),
        F.count_if(F.col("kind").isin("view", "click")).alias("cnt"),
        F.count_distinct("kind").alias("soc"),
    )
    o = collection_logs(spark, d).groupBy("competitor_id").agg(F.count("*").alias("runs"), F.count_if("success").alias("ok"), F.max("day").alias("ld"))
    out = reduce(lambda a, b: a.join(b, "competitor_id", "left"), (s, p, g, o), competitors(spark, d)).crossJoin(last)
    out = out.withColumn("price_age", F.datediff("price_day", "pd")).withColumn("log_age", F.datediff("log_day", "ld"))
    return out.drop("pd", "ld", "price_day", "change_day", "log_day").na.fill(0, ["svc", "src", "prc", "chg", "cnt", "soc", "runs", "ok"])


def ratio(name: str, whole: float) -> Column:
    return F.least(F.lit(1.0), F.col(name) / F.lit(whole))


#: Weights of the ten dimensions.
TEN = {
    "market_presence": 0.12,
    "growth_potential": 0.12,
    "innovation_score": 0.10,
    "pricing_competitiveness": 0.10,
    "regional_strength": 0.10,
    "digital_presence": 0.10,
    "service_diversity": 0.10,
    "customer_reach": 0.08,
    "technology_adoption": 0.08,
    "content_authority": 0.10,
}
_TEN_SQL = """
g AS (SELECT avg(svc) AS s, (SELECT avg(price) FROM pricing) AS p FROM inputs),
dims AS (SELECT competitor_id,
100 * least(1, svc / greatest(s, 1) * 0.5 + least(1, prc / 10.0::DOUBLE) * 0.3 + least(1, src / 10.0::DOUBLE) * 0.2) AS market_presence,
100 * (least(1, chg / 15.0::DOUBLE) * 0.6 + least(1, svc / 20.0::DOUBLE) * 0.4) AS growth_potential,
100 * (least(1, chg / 10.0::DOUBLE) * 0.4 + least(1, cnt / 15.0::DOUBLE) * 0.3 + least(1, prc / 8.0::DOUBLE) * 0.3) AS innovation_score,
CASE WHEN mean IS NULL THEN 30.0 ELSE 100 * greatest(0, 1 - abs(mean / p - 1)) END AS pricing_competitiveness,
100 * least(1, 0.3 + CASE WHEN nation = 'NATION_8' THEN 0.3 ELSE 0 END + CASE WHEN balance >= 5000 THEN 0.2 ELSE 0 END + CASE WHEN region = 'ASIA' THEN 0.2 ELSE 0 END)::DOUBLE AS regional_strength,
100 * (least(1, soc / 5.0::DOUBLE) * 0.6 + least(1, src / 10.0::DOUBLE) * 0.4) AS digital_presence,
100 * least(1, svc / greatest(s * 1.5, 1)) AS service_diversity,
100 * (least(1, soc / 4.0::DOUBLE) * 0.5 + least(1, prc / 8.0::DOUBLE) * 0.5) AS customer_reach,
100 * (least(1, soc / 3.0::DOUBLE) * 0.4 + least(1, src / 8.0::DOUBLE) * 0.3 + least(1, cnt / 10.0::DOUBLE) * 0.3) AS technology_adoption,
100 * (least(1, cnt / 15.0::DOUBLE) * 0.6 + least(1, prc / 6.0::DOUBLE) * 0.4) AS content_authority FROM inputs, g)"""


def ten_dimensions(spark, d) -> DataFrame:
    """competitor_id and the ten dimensions, 0 to 100. Tags stand on nation (home market), balance (first tier) and region."""
    i = inputs(spark, d)
    means = i.agg(F.avg("svc").alias("s")).crossJoin(pricing(spark, d).agg(F.avg("price").alias("p")))
    one = F.lit(1.0)
    tags = 0.3 + F.when(F.col("nation") == "NATION_8", 0.3).otherwise(0.0) + F.when(F.col("balance") >= 5000, 0.2).otherwise(0.0) + F.when(F.col("region") == "ASIA", 0.2).otherwise(0.0)
    dims = {
        "market_presence": F.least(one, F.col("svc") / F.greatest("s", one) * 0.5 + ratio("prc", 10) * 0.3 + ratio("src", 10) * 0.2),
        "growth_potential": ratio("chg", 15) * 0.6 + ratio("svc", 20) * 0.4,
        "innovation_score": ratio("chg", 10) * 0.4 + ratio("cnt", 15) * 0.3 + ratio("prc", 8) * 0.3,
        "pricing_competitiveness": F.when(F.col("mean").isNull(), 0.3).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("mean") / F.col("p") - 1))),
        "regional_strength": F.least(one, tags),
        "digital_presence": ratio("soc", 5) * 0.6 + ratio("src", 10) * 0.4,
        "service_diversity": F.least(one, F.col("svc") / F.greatest(F.col("s") * 1.5, one)),
        "customer_reach": ratio("soc", 4) * 0.5 + ratio("prc", 8) * 0.5,
        "technology_adoption": ratio("soc", 3) * 0.4 + ratio("src", 8) * 0.3 + ratio("cnt", 10) * 0.3,
        "content_authority": ratio("cnt", 15) * 0.6 + ratio("prc", 6) * 0.4,
    }
    return i.crossJoin(F.broadcast(means)).select("competitor_id", *[(100 * v).alias(k) for k, v in dims.items()])


@query("ten_dimension_scores", f"WITH {_TEN_SQL} SELECT competitor_id, dim, round(score, 4) AS score FROM (UNPIVOT dims ON COLUMNS(* EXCLUDE competitor_id) INTO NAME dim VALUE score)", *BASE)
def _(spark, d):
    return ten_dimensions(spark, d).unpivot(["competitor_id"], list(TEN), "dim", "score").withColumn("score", F.round("score", 4))


_OVERALL = " + ".join(f"{w} * {k}" for k, w in TEN.items())


@query(
    "composite_score_10d",
    f"""WITH {_TEN_SQL}, t AS (SELECT competitor_id, round({_OVERALL}, 2) AS overall FROM dims),
r AS (SELECT *, percent_rank() OVER (ORDER BY overall DESC) AS pr FROM t)
SELECT competitor_id, overall, row_number() OVER (ORDER BY overall DESC, competitor_id) AS rank,
CASE WHEN pr <= 0.1 THEN 'A' WHEN pr <= 0.35 THEN 'B' WHEN pr <= 0.65 THEN 'C' WHEN pr <= 0.9 THEN 'D' ELSE 'F' END AS grade FROM r""",
    *BASE,
)
def _(spark, d):
    t = ten_dimensions(spark, d).select("competitor_id", F.round(reduce(add, [w * F.col(k) for k, w in TEN.items()]), 2).alias("overall"))
    p = F.percent_rank().over(Window.orderBy(F.desc("overall")))  # a row a competitor
    grade = F.when(p <= 0.1, "A").when(p <= 0.35, "B").when(p <= 0.65, "C").when(p <= 0.9, "D").otherwise("F")
    rank = F.row_number().over(Window.orderBy(F.desc("overall"), "competitor_id"))
    return t.select("competitor_id", "overall", rank.cast("long").alias("rank"), grade.alias("grade"))


# --- confidence


def ladder(c: Column, steps: list[tuple[float, float]], other: float, up: bool = True) -> Column:
    """The value of the first step that c reaches (up: at least; else at most)."""
    out = F
    for at, value in steps:
        out = out.when(c >= at if up else c <= at, F.lit(value))
    return out.otherwise(F.lit(other))


def _case(c: str, steps: list[tuple[float, float]], other: float, up: bool = True) -> str:
    return "CASE " + " ".join(f"WHEN {c} {'>=' if up else '<='} {a} THEN {v}" for a, v in steps) + f" ELSE {other} END"


#: Sample sizes and ages in days, with their scores; the two engines differ in the first.
SAMPLE_5 = [(30, 1.0), (20, 0.9), (10, 0.7), (5, 0.5), (2, 0.3)]
SAMPLE_7 = [(20, 1.0), (10, 0.8), (5, 0.6), (2, 0.4)]
FRESH = [(1, 1.0), (7, 0.9), (30, 0.7), (90, 0.5)]
_RELIABLE = "CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END"


def reliability(score: str = "score") -> Column:
    return F.when(F.col(score) >= 0.7, "high").when(F.col(score) >= 0.4, "medium").otherwise("low")


@query(
    "confidence_factors",
    f"""WITH f AS (SELECT competitor_id, {_case('prc', SAMPLE_5, 0.1)} AS size, {_case('COALESCE(price_age, 999)', FRESH, 0.3, False)} AS fresh,
least(1, svc / 10.0::DOUBLE) AS complete, CASE WHEN runs > 0 THEN ok / runs::DOUBLE ELSE 0.5 END AS accuracy, 1 - least(COALESCE(sd / mean, 0), 1) AS stable FROM inputs),
t AS (SELECT competitor_id, round((0.20 * size + 0.20 * fresh + 0.15 * complete + 0.25 * accuracy + 0.20 * stable)::DOUBLE, 4) AS score FROM f)
SELECT competitor_id, score, {_RELIABLE} AS reliability FROM t""",
    *BASE,
)
def _(spark, d):
    size, fresh = ladder(F.col("prc"), SAMPLE_5, 0.1), ladder(F.coalesce("price_age", F.lit(999)), FRESH, 0.3, up=False)
    accuracy = F.when(F.col("runs") > 0, F.col("ok") / F.col("runs")).otherwise(0.5)
    stable = 1 - F.least(F.coalesce(F.col("sd") / F.col("mean"), F.lit(0.0)), F.lit(1.0))
    score = F.round(0.20 * size + 0.20 * fresh + 0.15 * ratio("svc", 10) + 0.25 * accuracy + 0.20 * stable, 4)
    return inputs(spark, d).select("competitor_id", score.alias("score")).withColumn("reliability", reliability())


@query(
    "confidence_7factor",
    f"""WITH f AS (SELECT competitor_id, {_case('ok + chg + svc', SAMPLE_7, 0.2)} AS size, {_case('COALESCE(price_age, 999)', FRESH, 0.3, False)} AS fresh,
least(1, (svc + prc + cnt) / 10.0::DOUBLE) AS complete, CASE WHEN runs > 0 THEN ok / runs::DOUBLE ELSE 0.5 END AS accuracy,
greatest(0, least(1, 1 - COALESCE(sd / mean, 0))) AS stable, least(1, chg / 20.0::DOUBLE) AS trend, CASE WHEN enabled THEN 0.8 ELSE 0.7 END AS source FROM inputs),
t AS (SELECT competitor_id, trend, round((0.15 * size + 0.15 * fresh + 0.15 * complete + 0.20 * accuracy + 0.10 * stable + 0.15 * trend + 0.10 * source)::DOUBLE, 4) AS score FROM f)
SELECT competitor_id, score, {_RELIABLE} AS reliability, CASE WHEN trend >= 0.7 THEN 'stable' WHEN trend >= 0.4 THEN 'moderate' ELSE 'volatile' END AS stability FROM t""",
    *BASE,
)
def _(spark, d):
    size = ladder(F.col("ok") + F.col("chg") + F.col("svc"), SAMPLE_7, 0.2)
    fresh = ladder(F.coalesce("price_age", F.lit(999)), FRESH, 0.3, up=False)
    complete = F.least(F.lit(1.0), (F.col("svc") + F.col("prc") + F.col("cnt")) / 10.0)
    accuracy = F.when(F.col("runs") > 0, F.col("ok") / F.col("runs")).otherwise(0.5)
    stable, trend = clamp(1 - F.coalesce(F.col("sd") / F.col("mean"), F.lit(0.0))), ratio("chg", 20)
    source = F.when(F.col("enabled"), 0.8).otherwise(0.7)
    score = F.round(0.15 * size + 0.15 * fresh + 0.15 * complete + 0.20 * accuracy + 0.10 * stable + 0.15 * trend + 0.10 * source, 4)
    steady = F.when(trend >= 0.7, "stable").when(trend >= 0.4, "moderate").otherwise("volatile")
    return inputs(spark, d).select("competitor_id", score.alias("score"), steady.alias("stability")).withColumn("reliability", reliability())


@query(
    "entity_quality",
    f"""WITH f AS (SELECT competitor_id, least(svc / 5.0::DOUBLE, 1) * 0.3 + least(prc / 5.0::DOUBLE, 1) * 0.3 + least(cnt / 3.0::DOUBLE, 1) * 0.2 + least(soc / 2.0::DOUBLE, 1) * 0.2 AS completeness,
CASE WHEN log_age IS NULL THEN 0 ELSE {_case('log_age', [(1, 1.0), (7, 0.85), (30, 0.65), (90, 0.40)], 0.2, False)} END AS freshness,
CASE WHEN runs > 0 THEN ok / runs::DOUBLE ELSE 0 END AS accuracy, CASE WHEN prc > 0 THEN least(1, svc / prc::DOUBLE) ELSE 0 END AS extraction FROM inputs),
t AS (SELECT *, completeness * 0.30 + freshness * 0.25 + accuracy * 0.25 + extraction * 0.20 AS overall FROM f)
SELECT competitor_id, round(completeness, 3) AS completeness, round(freshness, 3)::DOUBLE AS freshness, round(accuracy, 3) AS accuracy, round(extraction, 3) AS extraction,
round(overall, 3) AS overall, CASE WHEN overall >= 0.7 THEN 'high' WHEN overall >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM t""",
    *BASE,
)
def _(spark, d):
    complete = ratio("svc", 5) * 0.3 + ratio("prc", 5) * 0.3 + ratio("cnt", 3) * 0.2 + ratio("soc", 2) * 0.2
    fresh = F.when(F.col("log_age").isNull(), 0.0).otherwise(ladder(F.col("log_age"), [(1, 1.0), (7, 0.85), (30, 0.65), (90, 0.40)], 0.2, up=False))
    t = inputs(spark, d).select(
        "competitor_id",
        complete.alias("completeness"),
        fresh.alias("freshness"),
        F.when(F.col("runs") > 0, F.col("ok") / F.col("runs")).otherwise(0.0).alias("accuracy"),
        F.when(F.col("prc") > 0, F.least(F.lit(1.0), F.col("svc") / F.col("prc"))).otherwise(0.0).alias("extraction"),
    )
    t = t.withColumn("overall", F.expr("completeness * 0.30D + freshness * 0.25D + accuracy * 0.25D + extraction * 0.20D")).withColumn("level", reliability("overall"))
    return t.select("competitor_id", *[F.round(c, 3).alias(c) for c in ("completeness", "freshness", "accuracy", "extraction", "overall")], "level")


@query("calibrated_confidence", "SELECT doc_id, round((0.6 * quality + 0.4 * (1 - toxic))::DOUBLE, 4) AS confidence FROM labels")
def _(spark, d):
    return table(spark, d, "labels").select("doc_id", F.round(0.6 * F.col("quality") + 0.4 * (1 - F.col("toxic")), 4).alias("confidence"))


@query(
    "t_value",
    """WITH t AS (SELECT competitor_id, mean, sd, CASE WHEN prc - 1 >= 30 THEN 1.96 ELSE 1.96 * (1 + (1.96 * 1.96 + 1) / (4.0 * (prc - 1))) END::DOUBLE AS t FROM inputs WHERE prc >= 2)
SELECT competitor_id, round(t, 6) AS t, round(mean - t * sd, 4) AS lower, round(mean + t * sd, 4) AS upper FROM t""",
    *BASE,
)
def _(spark, d):
    df, z = F.col("prc") - 1, 1.96
    t = F.when(df >= 30, z).otherwise(z * (1 + (z * z + 1) / (4.0 * df)))
    i = inputs(spark, d).where("prc >= 2").withColumn("t", t)
    return i.select("competitor_id", F.round("t", 6).alias("t"), F.round(F.expr("mean - t * sd"), 4).alias("lower"), F.round(F.expr("mean + t * sd"), 4).alias("upper"))


#: Names of horizons and their days; others are 30.
HORIZONS = {
    "7d": 7, "7days": 7, "1w": 7,
    "30d": 30, "30days": 30, "1m": 30, "1month": 30,
    "90d": 90, "90days": 90, "3m": 90, "3months": 90, "1q": 90, "1quarter": 90,
    "180d": 180, "180days": 180, "6m": 180, "6months": 180,
    "365d": 365, "365days": 365, "1y": 365, "1year": 365,
}


def horizon_days(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in HORIZONS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(c))), F.lit(30))


@query("horizon_days", "SELECT p_partkey, label, CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in HORIZONS.items()) + " ELSE 30 END AS days FROM (SELECT p_partkey, p_size || (['d', 'days', 'm', 'y'])[p_partkey % 4 + 1] AS label FROM part)")
def _(spark, d):
    unit = F.element_at(F.array(*[F.lit(x) for x in ("d", "days", "m", "y")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("label"))
    return p.withColumn("days", horizon_days(F.concat(F.lit(" "), F.upper("label"))))


# --- observation quality and the validation pipeline

#: Weights of the seven dimensions.
SEVEN = {"completeness": 0.20, "accuracy": 0.20, "consistency": 0.15, "timeliness": 0.15, "validity": 0.10, "uniqueness": 0.10, "comparability": 0.10}
VIEWS["observations"] = """
observations AS (SELECT order_id, line, competitor_id, service_name, category, CASE WHEN discount < 0.1 THEN price END AS price, nation AS location,
CASE region WHEN 'EUROPE' THEN 'EUR' WHEN 'AMERICA' THEN 'USD' WHEN 'ASIA' THEN 'inr ' WHEN 'AFRICA' THEN 'ZAR' END AS currency,
(['unit', 'service', 'visit', 'Hour ', 'per_day'])[line % 5 + 1] AS unit, date_diff('day', day, (SELECT max(day) FROM pricing)) AS age,
row_number() OVER (PARTITION BY competitor_id, service_name, CASE WHEN discount < 0.1 THEN price END ORDER BY order_id, line) > 1 AS is_duplicate
FROM pricing JOIN competitors USING (competitor_id))"""
OBSERVED = ("competitors", "pricing", "observations")


def observations(spark, d) -> DataFrame:
    """Price observations as they come in: promotional prices are missing, currency and unit are written as sources do."""
    p = pricing(spark, d)
    last = F.broadcast(p.agg(F.max("day").alias("last")))
    rows = p.join(competitors(spark, d), "competitor_id").crossJoin(last)
    currency = F.when(F.col("region") == "EUROPE", "EUR").when(F.col("region") == "AMERICA", "USD").when(F.col("region") == "ASIA", "inr ").when(F.col("region") == "AFRICA", "ZAR")
    unit = F.element_at(F.array(*[F.lit(x) for x in ("unit", "service", "visit", "Hour ", "per_day")]), F.col("line") % 5 + 1)
    rows = rows.withColumn("price", F.when(F.col("discount") < 0.1, F.col("price"))).withColumn("currency", currency).withColumn("unit", unit)
    again = F.row_number().over(Window.partitionBy("competitor_id", "service_name", "price").orderBy("order_id", "line")) > 1
    return rows.select("order_id", "line", "competitor_id", "service_name", "category", "price", F.col("nation").alias("location"), "currency", "unit", F.datediff("last", "day").alias("age"), again.alias("is_duplicate"))


def seven_dimensions(o: DataFrame, comparability: Column) -> DataFrame:
    """o (service_name, price, currency, competitor_id, location, unit, age, is_duplicate) with the seven dimensions, overall,
    ml_ready and flags (array of the dimensions that are not whole)."""
    present = reduce(add, [F.col(c).isNotNull().cast("int") for c in ("service_name", "price", "currency", "competitor_id", "location")])
    known = F.upper(F.coalesce("currency", F.lit("INR"))).isin("INR", "USD", "EUR", "GBP")
    dims = {
        "completeness": F.round(present / 5, 2),
        "accuracy": F.when(F.col("price").isNull() | (F.col("price") <= 0), 0.0).when(F.col("price") > 500000, 0.5).otherwise(1.0),
        "consistency": F.when(known, 1.0).otherwise(0.5) - F.when(F.coalesce("unit", F.lit("")) == "", 0.3).otherwise(0.0),
        "timeliness": F.when(F.col("age") > 30, F.round(F.greatest(F.lit(0.2), 1 - (F.col("age") - 30) * 0.02), 2)).otherwise(1.0),
        "validity": F.when(F.length("service_name").between(3, 300), 1.0).otherwise(0.4),
        "uniqueness": F.when(F.col("is_duplicate"), 0.0).otherwise(1.0),
        "comparability": F.round(clamp(comparability), 2),
    }
    o = o.withColumns(dims)
    # Halves go up, whatever the order of the sum left of them.
    overall = F.round(F.round(reduce(add, [w * F.col(k) for k, w in SEVEN.items()]), 6) + 1e-9, 2)
    flags = F.array_compact(F.array(*[F.when(F.col(k) < (0.6 if k == "comparability" else 1.0), k) for k in SEVEN]))
    return o.withColumn("overall", overall).withColumn("ml_ready", (F.col("overall") >= 0.7) & ~F.col("is_duplicate") & (F.col("accuracy") > 0)).withColumn("flags", flags)


_SEVEN_SQL = """
d7 AS (SELECT *, round((1 + (price IS NOT NULL)::INT + (currency IS NOT NULL)::INT + 1 + (location IS NOT NULL)::INT) / 5.0::DOUBLE, 2) AS completeness,
CASE WHEN price IS NULL OR price <= 0 THEN 0.0 WHEN price > 500000 THEN 0.5 ELSE 1.0 END AS accuracy,
CASE WHEN upper(COALESCE({currency}, 'INR')) IN ('INR', 'USD', 'EUR', 'GBP') THEN 1.0 ELSE 0.5 END AS consistency,
CASE WHEN age > 30 THEN round(greatest(0.2, 1 - (age - 30) * 0.02)::DOUBLE, 2) ELSE 1.0 END AS timeliness,
CASE WHEN length(service_name) BETWEEN 3 AND 300 THEN 1.0 ELSE 0.4 END AS validity, CASE WHEN is_duplicate THEN 0.0 ELSE 1.0 END AS uniqueness, 0.8 AS comparability FROM {source}),
o7 AS (SELECT *, round(round((0.20 * completeness + 0.20 * accuracy + 0.15 * consistency + 0.15 * timeliness + 0.10 * validity + 0.10 * uniqueness + 0.10 * comparability)::DOUBLE, 6) + 1e-9, 2) AS overall,
array_to_string(list_filter([CASE WHEN completeness < 1 THEN 'completeness' END, CASE WHEN accuracy < 1 THEN 'accuracy' END, CASE WHEN consistency < 1 THEN 'consistency' END,
CASE WHEN timeliness < 1 THEN 'timeliness' END, CASE WHEN validity < 1 THEN 'validity' END, CASE WHEN uniqueness < 1 THEN 'uniqueness' END], lambda x: x IS NOT NULL), ',') AS flags FROM d7)"""


@query(
    "observation_quality",
    f"WITH {_SEVEN_SQL.format(source='observations', currency='currency')} SELECT order_id, line, overall AS score, is_duplicate, overall >= 0.7 AND NOT is_duplicate AND accuracy > 0 AS ml_ready, flags FROM o7",
    *OBSERVED,
)
def _(spark, d):
    q = seven_dimensions(observations(spark, d), F.lit(0.8))
    return q.select("order_id", "line", F.col("overall").alias("score"), "is_duplicate", "ml_ready", F.array_join("flags", ",").alias("flags"))


#: Units as sources write them.
UNITS = {"unit": "per_unit", "service": "per_service", "visit": "per_visit", "hour": "per_hour"}


def validated(o: DataFrame, comparability: Column) -> DataFrame:
    """The stages after each other as columns: schema, duplicates (is_duplicate), units, currencies, outliers, quality, review
    and the training filter. status: rejected (no name or price, or none above 0), flagged, validated."""
    unit = F.lower(F.trim("unit"))
    names = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    money = F.upper(F.trim(F.coalesce("currency", F.lit("INR"))))
    o = o.withColumn("unit", F.coalesce(F.try_element_at(names, unit), unit)).withColumn("currency", F.when(money.isin("USD", "EUR", "GBP"), money).otherwise("INR"))
    q = seven_dimensions(o, comparability)
    bad = F.col("service_name").isNull() | (F.col("service_name") == "") | F.col("price").isNull() | (F.col("price") <= 0)
    review = (F.col("overall") < 0.7) | (F.size("flags") > 0) | F.col("is_duplicate") | (F.col("price") > 100000)
    status = F.when(bad, "rejected").when(review, "flagged_for_review").otherwise("validated")
    return q.withColumn("status", status).withColumn("ml_ready", F.col("ml_ready") & (F.col("status") == "validated"))


_VALID_SQL = (
    """n AS (SELECT * EXCLUDE (unit, currency), CASE lower(trim(unit)) WHEN 'unit' THEN 'per_unit' WHEN 'service' THEN 'per_service' WHEN 'visit' THEN 'per_visit' WHEN 'hour' THEN 'per_hour' ELSE lower(trim(unit)) END AS unit,
CASE WHEN upper(trim(COALESCE(currency, 'INR'))) IN ('USD', 'EUR', 'GBP') THEN upper(trim(currency)) ELSE 'INR' END AS currency FROM observations),"""
    + _SEVEN_SQL.format(source="n", currency="currency")
    + """, v AS (SELECT *, CASE WHEN service_name IS NULL OR service_name = '' OR price IS NULL OR price <= 0 THEN 'rejected' WHEN overall < 0.7 OR flags <> '' OR is_duplicate OR price > 100000 THEN 'flagged_for_review' ELSE 'validated' END AS status FROM o7)"""
)


@query("validation_pipeline", f"WITH {_VALID_SQL} SELECT order_id, line, unit, currency, overall, status, status = 'validated' AND overall >= 0.7 AND NOT is_duplicate AND accuracy > 0 AS ml_ready FROM v", *OBSERVED)
def _(spark, d):
    return validated(observations(spark, d), F.lit(0.8)).select("order_id", "line", "unit", "currency", "overall", "status", "ml_ready")


@query("validation_counts", f"WITH {_VALID_SQL} SELECT status, count(*) AS n, round(avg(overall), 4) AS mean_quality FROM v GROUP BY 1", *OBSERVED)
def _(spark, d):
    return validated(observations(spark, d), F.lit(0.8)).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("overall"), 4).alias("mean_quality"))


# --- opportunities, risks and recommendations by rule


@query(
    "miner_opportunities",
    """WITH g AS (SELECT 'pricing_gap' AS kind, category AS subject, least(100, 100 * (max(price) - min(price)) / avg(price)) AS score FROM pricing
GROUP BY 2 HAVING count(*) >= 2 AND avg(price) > 0 AND max(price) - min(price) > 0.25 * avg(price)),
c AS (SELECT 'category_gap', category || '/' || brand, least(100, count(DISTINCT competitor_id) * 15.0) FROM services
WHERE (category, brand) NOT IN (SELECT category, brand FROM services WHERE competitor_id = 1) GROUP BY 2 HAVING count(DISTINCT competitor_id) >= 2),
r AS (SELECT 'geographic_gap', r_name, 70.0 FROM region WHERE r_name NOT IN (SELECT region FROM competitors WHERE competitor_id = 1))
SELECT kind, subject, round(score::DOUBLE, 1) AS score FROM (SELECT * FROM g UNION ALL SELECT * FROM c UNION ALL SELECT * FROM r)
ORDER BY round(score::DOUBLE, 1) DESC, kind, subject LIMIT 15""",
    "pricing",
    "services",
    "competitors",
)
def _(spark, d):
    """For competitor 1: what mine() of the decision rules reports, the 15 of most score."""
    spread = F.max("price") - F.min("price")
    g = pricing(spark, d).groupBy(F.col("category").alias("subject")).agg(F.count("*").alias("n"), F.avg("price").alias("mean"), spread.alias("spread"))
    g = g.where("n >= 2 and mean > 0 and spread > 0.25 * mean").select(F.lit("pricing_gap").alias("kind"), "subject", F.least(F.lit(100.0), 100 * F.col("spread") / F.col("mean")).alias("score"))
    s = services(spark, d)
    own = s.where("competitor_id = 1").select("category", "brand").distinct()
    c = s.join(own, ["category", "brand"], "left_anti").groupBy("category", "brand").agg(F.count_distinct("competitor_id").alias("n")).where("n >= 2")
    c = c.select(F.lit("category_gap").alias("kind"), F.concat_ws("/", "category", "brand").alias("subject"), F.least(F.lit(100.0), F.col("n") * 15.0).alias("score"))
    home = competitors(spark, d).where("competitor_id = 1").select(F.col("region").alias("r_name"))
    r = table(spark, d, "region").join(home, "r_name", "left_anti").select(F.lit("geographic_gap").alias("kind"), F.col("r_name").alias("subject"), F.lit(70.0).alias("score"))
    return g.unionByName(c).unionByName(r).withColumn("score", F.round("score", 1)).orderBy(F.desc("score"), "kind", "subject").limit(15)


_SIGNALS = """
mid AS (SELECT (SELECT min(day) FROM pricing) + CAST(date_diff('day', (SELECT min(day) FROM pricing), (SELECT max(day) FROM pricing)) // 2 AS INT) AS price_mid,
(SELECT max(day) FROM changes) - 15 AS change_mid),
tr AS (SELECT competitor_id, avg(price) FILTER (day > price_mid) / avg(price) FILTER (day <= price_mid) - 1 AS price_trend FROM pricing, mid GROUP BY 1),
gr AS (SELECT competitor_id, count(*) FILTER (day > change_mid) / greatest(count(*) FILTER (day <= change_mid), 1)::DOUBLE - 1 AS growth FROM changes, mid GROUP BY 1),
br AS (SELECT count(DISTINCT brand) AS brands, avg(svc) AS mean_svc FROM services, (SELECT avg(svc) AS svc FROM inputs)),
sig AS (SELECT i.competitor_id, COALESCE(price_trend, 0) AS price_trend, COALESCE(growth, 0) AS growth, src / brands::DOUBLE AS overlap, svc - mean_svc AS delta, chg, brands - src AS gap
FROM inputs i CROSS JOIN br LEFT JOIN tr USING (competitor_id) LEFT JOIN gr USING (competitor_id))"""


def signals(spark, d) -> DataFrame:
    """competitor_id, price_trend (second half of the time against the first), growth (changes of the last 15 days against those
    before), overlap (share of all brands), delta (services above the mean), chg, gap (brands it lacks)."""
    p, e, i = pricing(spark, d), change_events(spark, d), inputs(spark, d)
    mid = p.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.date_add("a", F.floor(F.datediff("b", "a") / 2).cast("int")).alias("price_mid"))
    late = F.col("day") > F.col("price_mid")
    tr = p.crossJoin(F.broadcast(mid)).groupBy("competitor_id").agg((F.avg(F.when(late, F.col("price"))) / F.avg(F.when(~late, F.col("price"))) - 1).alias("price_trend"))
    cut = e.agg(F.date_sub(F.max("day"), 15).alias("change_mid"))
    new = F.col("day") > F.col("change_mid")
    gr = e.crossJoin(F.broadcast(cut)).groupBy("competitor_id").agg((F.count_if(new) / F.greatest(F.count_if(~new), F.lit(1)) - 1).alias("growth"))
    whole = services(spark, d).agg(F.count_distinct("brand").alias("brands")).crossJoin(i.agg(F.avg("svc").alias("mean_svc")))
    out = i.join(tr, "competitor_id", "left").join(gr, "competitor_id", "left").crossJoin(F.broadcast(whole)).na.fill(0.0, ["price_trend", "growth"])
    return out.select("competitor_id", "price_trend", "growth", (F.col("src") / F.col("brands")).alias("overlap"), (F.col("svc") - F.col("mean_svc")).alias("delta"), "chg", (F.col("brands") - F.col("src")).alias("gap"))


#: Scores from which a risk is high, and medium.
THRESHOLDS = {"price_war": (0.7, 0.4), "market_share_erosion": (0.6, 0.3), "expansion_collision": (0.65, 0.35), "service_commoditization": (0.6, 0.3)}
_RISKS = """
risks AS (SELECT competitor_id, 'price_war' AS risk, least(1, abs(price_trend) * 3) AS score FROM sig WHERE price_trend < -0.15
UNION ALL SELECT competitor_id, 'market_share_erosion', least(1, growth * 2 + delta * 0.02) FROM sig WHERE growth > 0.2 AND delta > 5
UNION ALL SELECT competitor_id, 'expansion_collision', overlap FROM sig WHERE overlap > 0.6
UNION ALL SELECT competitor_id, 'service_commoditization', least(1, chg * 0.05)::DOUBLE FROM sig WHERE chg > 10)"""
_LEVEL = "CASE WHEN " + " OR ".join(f"(risk = '{k}' AND score >= {h})" for k, (h, _) in THRESHOLDS.items()) + " THEN 'HIGH' WHEN " + " OR ".join(f"(risk = '{k}' AND score >= {m})" for k, (_, m) in THRESHOLDS.items()) + " THEN 'MEDIUM' ELSE 'LOW' END"


def risk_rows(s: DataFrame) -> DataFrame:
    """competitor_id, risk, score, level of signals()."""
    one = F.lit(1.0)
    rules = {
        "price_war": (F.col("price_trend") < -0.15, F.least(one, F.abs("price_trend") * 3)),
        "market_share_erosion": ((F.col("growth") > 0.2) & (F.col("delta") > 5), F.least(one, F.col("growth") * 2 + F.col("delta") * 0.02)),
        "expansion_collision": (F.col("overlap") > 0.6, F.col("overlap")),
        "service_commoditization": (F.col("chg") > 10, F.least(one, F.col("chg") * 0.05)),
    }
    level = lambda k, c: F.when(c >= THRESHOLDS[k][0], "HIGH").when(c >= THRESHOLDS[k][1], "MEDIUM").otherwise("LOW")
    each = [F.when(when, F.struct(F.lit(k).alias("risk"), c.alias("score"), level(k, c).alias("level"))) for k, (when, c) in rules.items()]
    return s.select("competitor_id", F.explode(F.array_compact(F.array(*each))).alias("r")).select("competitor_id", "r.*")


@query("strategic_risks", f"WITH {_SIGNALS}, {_RISKS} SELECT competitor_id, risk, round(score, 3) AS score, {_LEVEL} AS level FROM risks", *BASE)
def _(spark, d):
    return risk_rows(signals(spark, d)).withColumn("score", F.round("score", 3))


@query(
    "rule_recommendations",
    f"""WITH {_SIGNALS}, {_RISKS}, high AS (SELECT competitor_id, count(*) n FROM risks WHERE {_LEVEL} = 'HIGH' GROUP BY 1),
recs AS (SELECT competitor_id, 'growth_response' AS category, 'HIGH' AS impact, 0.85 AS confidence FROM sig WHERE growth > 0.15
UNION ALL SELECT competitor_id, 'growth_opportunity', 'MEDIUM', 0.75 FROM sig WHERE growth < -0.05
UNION ALL SELECT competitor_id, 'risk_mitigation', 'HIGH', 0.9 FROM high
UNION ALL SELECT competitor_id, 'pricing_strategy', CASE WHEN price_trend < 0 THEN 'HIGH' ELSE 'MEDIUM' END, CASE WHEN price_trend < 0 THEN 0.8 ELSE 0.7 END FROM sig WHERE abs(price_trend) > 0.2
UNION ALL SELECT competitor_id, 'service_expansion', 'MEDIUM', 0.8 FROM sig WHERE gap > 3)
SELECT competitor_id, category, impact, confidence::DOUBLE AS confidence, row_number() OVER (PARTITION BY competitor_id ORDER BY confidence DESC, category) AS place FROM recs
QUALIFY place <= 8""",
    *BASE,
)
def _(spark, d):
    s = signals(spark, d)
    high = risk_rows(s).where("level = 'HIGH'").groupBy("competitor_id").agg(F.count("*").alias("high"))
    s = s.join(high, "competitor_id", "left")
    rec = lambda when, category, impact, sure: F.when(when, F.struct((-F.lit(sure)).alias("by"), F.lit(category).alias("category"), F.lit(impact).alias("impact"), F.lit(sure).alias("confidence")))
    each = [
        rec(F.col("growth") > 0.15, "growth_response", "HIGH", 0.85),
        rec(F.col("growth") < -0.05, "growth_opportunity", "MEDIUM", 0.75),
        rec(F.col("high") > 0, "risk_mitigation", "HIGH", 0.9),
        rec(F.col("price_trend") < -0.2, "pricing_strategy", "HIGH", 0.8),
        rec(F.col("price_trend") > 0.2, "pricing_strategy", "MEDIUM", 0.7),
        rec(F.col("gap") > 3, "service_expansion", "MEDIUM", 0.8),
    ]
    top = F.slice(F.array_sort(F.array_compact(F.array(*each))), 1, 8)
    out = s.select("competitor_id", F.posexplode(top).alias("place", "r"))
    return out.select("competitor_id", "r.category", "r.impact", "r.confidence", (F.col("place") + 1).cast("long").alias("place"))


@query(
    "url_and_service_gaps",
    """WITH m AS (SELECT n_name AS place, count(DISTINCT s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT r_name AS place, 'geographic_gap' AS signal, 0.6::DOUBLE AS score FROM region WHERE NOT EXISTS (SELECT 1 FROM pages WHERE contains(lower(url), lower(r_name)))
UNION ALL SELECT place, 'service_gap', round(0.7 - n * 0.1, 2)::DOUBLE FROM m WHERE n < 3""",
)
def _(spark, d):
    r = table(spark, d, "region").select(F.col("r_name").alias("place"))
    seen = table(spark, d, "pages").select(F.lower("url").alias("url"))
    missing = r.join(seen, F.contains(seen.url, F.lower(r.place)), "left_anti").select("place", F.lit("geographic_gap").alias("signal"), F.lit(0.6).alias("score"))
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("k"))
    few = n.join(s, n.n_nationkey == s.s_nationkey, "left").select(F.col("n_name").alias("place"), F.coalesce("k", F.lit(0)).alias("n")).where("n < 3")
    return missing.unionByName(few.select("place", F.lit("service_gap").alias("signal"), F.round(0.7 - F.col("n") * 0.1, 2).alias("score")))


@query(
    "adoption_band",
    """WITH k AS (SELECT brand, count(DISTINCT competitor_id) AS n FROM services GROUP BY 1), m AS (SELECT avg(n) AS mean FROM k),
x AS (SELECT competitor_id, brand, h AS horizon, least(0.98, greatest(0.15, CASE WHEN n >= mean THEN 0.85 ELSE 0.45 END + CASE WHEN region = 'ASIA' THEN 0.08 WHEN NOT enabled THEN -0.05 ELSE 0.02 END + 0.04 * h / 30.0)) AS p
FROM competitors, k, m, (SELECT unnest([30, 90, 180]) AS h))
SELECT competitor_id, brand, horizon, round(p::DOUBLE, 4) AS probability, CASE WHEN round(p::DOUBLE, 4) >= 0.8 THEN 'High likelihood' WHEN round(p::DOUBLE, 4) >= 0.6 THEN 'Moderate likelihood' WHEN round(p::DOUBLE, 4) >= 0.4 THEN 'Uncertain' ELSE 'Low likelihood' END AS band FROM x""",
    "competitors",
    "services",
)
def _(spark, d):
    k = services(spark, d).groupBy("brand").agg(F.count_distinct("competitor_id").alias("n"))
    k = k.crossJoin(k.agg(F.avg("n").alias("mean")))  # a row a brand
    base = F.when(F.col("n") >= F.col("mean"), 0.85).otherwise(0.45)
    own = F.when(F.col("region") == "ASIA", 0.08).when(~F.col("enabled"), -0.05).otherwise(0.02)
    p = F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.15), base + own + 0.04 * F.col("horizon") / 30)), 4)
    band = F.when(p >= 0.8, "High likelihood").when(p >= 0.6, "Moderate likelihood").when(p >= 0.4, "Uncertain").otherwise("Low likelihood")
    rows = competitors(spark, d).crossJoin(F.broadcast(k)).withColumn("horizon", F.explode(F.array(F.lit(30), F.lit(90), F.lit(180))))
    return rows.select("competitor_id", "brand", "horizon", p.alias("probability"), band.alias("band"))


# --- words about numbers


@query(
    "explanations",
    f"""WITH {_SIGNALS} SELECT competitor_id, concat_ws('; ', CASE WHEN svc > 0 THEN svc || ' services in ' || src || ' brands' END, CASE WHEN prc > 0 THEN prc || ' prices, mean ' || printf('%.2f', round(mean, 2)) END,
CASE WHEN i.chg > 0 THEN i.chg || ' changes in 30 days' END, CASE WHEN runs > 0 THEN ok || ' of ' || runs || ' runs succeeded' END) AS evidence,
round(((svc > 0)::INT + (prc > 0)::INT + (i.chg > 0)::INT + (runs > 0)::INT) / 4.0::DOUBLE, 2) AS coverage FROM inputs i JOIN sig USING (competitor_id)""",
    *BASE,
)
def _(spark, d):
    part = lambda c, text: F.when(F.col(c) > 0, text)
    text = F.concat_ws(
        "; ",
        part("svc", F.concat("svc", F.lit(" services in "), "src", F.lit(" brands"))),
        part("prc", F.concat("prc", F.lit(" prices, mean "), F.format_string("%.2f", F.round("mean", 2)))),
        part("chg", F.concat("chg", F.lit(" changes in 30 days"))),
        part("runs", F.concat("ok", F.lit(" of "), "runs", F.lit(" runs succeeded"))),
    )
    known = reduce(add, [(F.col(c) > 0).cast("int") for c in ("svc", "prc", "chg", "runs")])
    return inputs(spark, d).select("competitor_id", text.alias("evidence"), F.round(known / 4, 2).alias("coverage"))


@query(
    "report_sections",
    f"""WITH {_SIGNALS}, {_RISKS} SELECT 1 AS place, 'market' AS section, count(*) || ' competitors, ' || sum(svc) || ' services' AS text FROM inputs
UNION ALL SELECT 2, 'pricing', count(*) || ' prices in ' || count(DISTINCT category) || ' categories' FROM pricing
UNION ALL SELECT 3, 'growth', count(*) FILTER (growth > 0.15) || ' growing, ' || count(*) FILTER (growth < -0.05) || ' declining' FROM sig
UNION ALL SELECT 4, 'risks', count(*) || ' risks, ' || count(*) FILTER ({_LEVEL} = 'HIGH') || ' high' FROM risks
UNION ALL SELECT 5, 'collection', sum(ok) || ' of ' || sum(runs) || ' runs succeeded' FROM inputs""",
    *BASE,
)
def _(spark, d):
    i, s = inputs(spark, d), signals(spark, d)
    parts = [
        ("market", i.agg(F.concat(F.count("*"), F.lit(" competitors, "), F.sum("svc"), F.lit(" services")).alias("text"))),
        ("pricing", pricing(spark, d).agg(F.concat(F.count("*"), F.lit(" prices in "), F.count_distinct("category"), F.lit(" categories")).alias("text"))),
        ("growth", s.agg(F.concat(F.count_if(F.col("growth") > 0.15), F.lit(" growing, "), F.count_if(F.col("growth") < -0.05), F.lit(" declining")).alias("text"))),
        ("risks", risk_rows(s).agg(F.concat(F.count("*"), F.lit(" risks, "), F.count_if(F.col("level") == "HIGH"), F.lit(" high")).alias("text"))),
        ("collection", i.agg(F.concat(F.sum("ok"), F.lit(" of "), F.sum("runs"), F.lit(" runs succeeded")).alias("text"))),
    ]
    return reduce(DataFrame.unionByName, [t.select(F.lit(k).alias("place"), F.lit(name).alias("section"), "text") for k, (name, t) in enumerate(parts, 1)])


@query(
    "agent_findings",
    """SELECT 'pricing' AS agent, 'mean_price' AS metric, round(avg(price), 4) AS value FROM pricing UNION ALL SELECT 'services', 'brands', count(DISTINCT brand) FROM services
UNION ALL SELECT 'changes', 'kinds', count(DISTINCT kind) FROM changes UNION ALL SELECT 'collection', 'success_rate', round(count(*) FILTER (success) / count(success)::DOUBLE, 4) FROM logs
UNION ALL SELECT 'market', 'regions', count(DISTINCT region) FROM competitors UNION ALL SELECT 'feedback', 'approval', round(avg(quality), 4) FROM labels""",
    "competitors",
    "services",
    "pricing",
    "changes",
    "logs",
)
def _(spark, d):
    """Six agents, each an aggregate of its own, merged into one table."""
    parts = [
        ("pricing", "mean_price", pricing(spark, d), F.avg("price")),
        ("services", "brands", services(spark, d), F.count_distinct("brand")),
        ("changes", "kinds", change_events(spark, d), F.count_distinct("kind")),
        ("collection", "success_rate", collection_logs(spark, d), F.count_if("success") / F.count("success")),
        ("market", "regions", competitors(spark, d), F.count_distinct("region")),
        ("feedback", "approval", table(spark, d, "labels"), F.avg("quality")),
    ]
    return reduce(DataFrame.unionByName, [t.agg(F.round(v.cast("double"), 4).alias("value")).select(F.lit(a).alias("agent"), F.lit(m).alias("metric"), "value") for a, m, t, v in parts])


@query(
    "kpi_means",
    """WITH f AS (SELECT category, avg(price) FILTER (discount < 0.1) AS list_price, avg(price) FILTER (competitor_id = 1) AS own, avg(price) AS market FROM pricing GROUP BY 1)
SELECT category, round(COALESCE(list_price, market), 4) AS list_price, round(COALESCE(own, market), 4) AS own_price, round(market - COALESCE(own, market), 4) AS gap,
round(100 * (market - COALESCE(own, market)) / market, 4) AS gap_pct, own IS NULL AS is_fallback FROM f""",
    "pricing",
)
def _(spark, d):
    p = F.col("price")
    f = pricing(spark, d).groupBy("category").agg(F.avg(F.when(F.col("discount") < 0.1, p)).alias("l"), F.avg(F.when(F.col("competitor_id") == 1, p)).alias("o"), F.avg(p).alias("market"))
    own = F.coalesce("o", "market")
    gap = F.col("market") - own
    return f.select("category", F.round(F.coalesce("l", "market"), 4).alias("list_price"), F.round(own, 4).alias("own_price"), F.round(gap, 4).alias("gap"), F.round(100 * gap / F.col("market"), 4).alias("gap_pct"), F.col("o").isNull().alias("is_fallback"))


@query("strategy_metrics", "SELECT CASE WHEN success IS NULL THEN 'unknown' WHEN success THEN 'accepted' ELSE 'rejected' END AS outcome, count(*) AS n, min(records) AS least, round(avg(records), 4) AS mean, max(records) AS most, round(count(*) / (SELECT count(*) FROM logs)::DOUBLE, 6) AS share FROM logs GROUP BY 1", "logs")
def _(spark, d):
    o = collection_logs(spark, d)
    outcome = F.when(F.col("success").isNull(), "unknown").when(F.col("success"), "accepted").otherwise("rejected")
    g = o.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.min("records").alias("least"), F.round(F.avg("records"), 4).alias("mean"), F.max("records").alias("most"))
    return g.crossJoin(F.broadcast(o.agg(F.count("*").alias("all")))).select("outcome", "n", "least", "mean", "most", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query(
    "strategy_ranking",
    """WITH g AS (SELECT kind, avg((value >= 50)::INT) AS success, avg(least(1, value / 100)) AS confidence, 1 - least(1, count(*) / (SELECT count(*) FROM changes)::DOUBLE) AS speed FROM changes GROUP BY 1)
SELECT kind, round(0.5 * success + 0.3 * confidence + 0.2 * speed, 6) AS score, row_number() OVER (ORDER BY 0.5 * success + 0.3 * confidence + 0.2 * speed DESC, kind) AS place FROM g""",
    "changes",
)
def _(spark, d):
    """Adaptive order of strategies (kinds of runs): success, confidence and speed, weighed."""
    e = change_events(spark, d)
    g = e.groupBy("kind").agg(F.avg((F.col("value") >= 50).cast("int")).alias("s"), F.avg(F.least(F.lit(1.0), F.col("value") / 100)).alias("c"), F.count("*").alias("n"))
    g = g.crossJoin(F.broadcast(e.agg(F.count("*").alias("all"))))
    score = 0.5 * F.col("s") + 0.3 * F.col("c") + 0.2 * (1 - F.least(F.lit(1.0), F.col("n") / F.col("all")))
    g = g.select("kind", score.alias("raw"))
    return g.select("kind", F.round("raw", 6).alias("score"), F.row_number().over(Window.orderBy(F.desc("raw"), "kind")).cast("long").alias("place"))
