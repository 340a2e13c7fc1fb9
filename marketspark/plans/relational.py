"""Filters, joins, aggregates, ranks and set operations over the market views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketspark.operators import graph as G
from marketspark.operators import relational as R
from marketspark.operators.matching import contained
from marketspark.operators.selection import at_ranks, quantiles
from marketspark.plans.registry import query
from marketspark.sources.tables import change_events, collection_logs, competitors, pricing, services, table


def _round(c, n=4):
    return F.round(c, n)


@query("summary_multi_left_join", """
SELECT c.competitor_id, c.name, COALESCE(s.n, 0) AS services, COALESCE(p.n, 0) AS prices, COALESCE(p.d, 0) AS price_days, COALESCE(q.n, 0) AS categories
FROM competitors c LEFT JOIN (SELECT competitor_id, count(*) n, 0 FROM services GROUP BY 1) s USING (competitor_id)
LEFT JOIN (SELECT competitor_id, count(*) n, count(DISTINCT day) d FROM pricing GROUP BY 1) p USING (competitor_id)
LEFT JOIN (SELECT competitor_id, count(DISTINCT category) n FROM services GROUP BY 1) q USING (competitor_id)""", "competitors", "services", "pricing")  # fmt: skip
def _(spark, d):
    s = services(spark, d).groupBy("competitor_id").agg(F.count("*").alias("services"), F.count_distinct("category").alias("categories"))
    p = pricing(spark, d).groupBy("competitor_id").agg(F.count("*").alias("prices"), F.count_distinct("day").alias("price_days"))
    return competitors(spark, d).select("competitor_id", "name").join(s, "competitor_id", "left").join(p, "competitor_id", "left").na.fill(0).select("competitor_id", "name", "services", "prices", "price_days", "categories")


@query("fact_to_dim_join", "SELECT p.competitor_id, c.name, p.category, p.price FROM pricing p JOIN competitors c USING (competitor_id) WHERE p.price > 1500", "pricing", "competitors")
def _(spark, d):
    return pricing(spark, d).where("price > 1500").join(competitors(spark, d).select("competitor_id", "name"), "competitor_id").select("competitor_id", "name", "category", "price")


@query("correlated_counts", """
SELECT c_custkey AS competitor_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS runs,
(SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS failed, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS changes FROM customer""")
def _(spark, d):
    runs = collection_logs(spark, d).groupBy("competitor_id").agg(F.count("*").alias("runs"), F.count_if(F.col("success") == F.lit(False)).alias("failed"))
    ch = change_events(spark, d).groupBy("competitor_id").agg(F.count("*").alias("changes"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("competitor_id"))
    return c.join(runs, "competitor_id", "left").join(ch, "competitor_id", "left").na.fill(0)


@query("prediction_join", """
SELECT s.competitor_id, s.service_id, s.price AS current_price, round(p_mean, 4) AS market_price, round(100 * (s.price - p_mean) / p_mean, 4) AS gap_pct
FROM services s JOIN (SELECT service_id, avg(price) p_mean FROM pricing GROUP BY 1 HAVING count(*) >= 3) m USING (service_id)""", "services", "pricing")
def _(spark, d):
    m = pricing(spark, d).groupBy("service_id").agg(F.avg("price").alias("m"), F.count("*").alias("n")).where("n >= 3")
    return services(spark, d).join(m, "service_id").select("competitor_id", "service_id", F.col("price").alias("current_price"), _round(F.col("m")).alias("market_price"), _round(100 * (F.col("price") - F.col("m")) / F.col("m")).alias("gap_pct"))


@query("nulls_last_join", """
SELECT o_orderkey AS log_id, c_name AS name, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price,
row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey) AS rank
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    rows = o.withColumn("price", price).join(c, o.o_custkey == c.c_custkey)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("price"), "o_orderkey"))
    return rows.select(F.col("o_orderkey").alias("log_id"), F.col("c_name").alias("name"), "price", place.cast("long").alias("rank"))


@query("cross_join_catalog", """
SELECT c.competitor_id, t.category, round(t.mean, 4) AS catalog_price, round(COALESCE(o.mean, t.mean), 4) AS own_price, (o.mean IS NOT NULL) AS offered
FROM competitors c CROSS JOIN (SELECT category, avg(price) mean FROM pricing GROUP BY 1) t
LEFT JOIN (SELECT competitor_id, category, avg(price) mean FROM pricing GROUP BY 1, 2) o ON o.competitor_id = c.competitor_id AND o.category = t.category""", "competitors", "pricing")  # fmt: skip
def _(spark, d):
    p = pricing(spark, d)
    t = p.groupBy("category").agg(F.avg("price").alias("t"))  # a row a category
    o = p.groupBy("competitor_id", "category").agg(F.avg("price").alias("o"))
    every = competitors(spark, d).select("competitor_id").crossJoin(t)
    return every.join(o, ["competitor_id", "category"], "left").select("competitor_id", "category", _round(F.col("t")).alias("catalog_price"), _round(F.coalesce("o", "t")).alias("own_price"), F.col("o").isNotNull().alias("offered"))


@query("theta_contains_join", "SELECT doc_id, r_name AS region FROM documents, region WHERE contains(lower(text), lower(substr(r_name, 1, 3)))")
def _(spark, d):
    r = table(spark, d, "region").select("r_name")  # five rows
    return table(spark, d, "documents").crossJoin(F.broadcast(r)).where("contains(lower(text), lower(substr(r_name, 1, 3)))").select("doc_id", F.col("r_name").alias("region"))


@query("anti_join_category_gap", """
SELECT b.service_id, b.n AS rivals FROM (SELECT service_id, count(DISTINCT competitor_id) n FROM services WHERE competitor_id <> 1 GROUP BY 1 HAVING count(DISTINCT competitor_id) >= 2) b
WHERE b.service_id NOT IN (SELECT service_id FROM services WHERE competitor_id = 1)""", "services")
def _(spark, d):
    s = services(spark, d)
    rivals = s.where("competitor_id <> 1").groupBy("service_id").agg(F.count_distinct("competitor_id").alias("rivals")).where("rivals >= 2")
    return rivals.join(s.where("competitor_id = 1").select("service_id"), "service_id", "left_anti")


@query("anti_join_region_gap", """
SELECT c.competitor_id, r_name AS region FROM competitors c, region r WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_regionkey = r.r_regionkey AND o_custkey = c.competitor_id)""", "competitors")
def _(spark, d):
    o, cu, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    seen = o.join(cu, o.o_custkey == cu.c_custkey).join(n, cu.c_nationkey == n.n_nationkey).select(F.col("o_custkey").alias("competitor_id"), F.col("n_regionkey").alias("r_regionkey")).distinct()
    every = competitors(spark, d).select("competitor_id").crossJoin(F.broadcast(table(spark, d, "region")))
    return every.join(seen, ["competitor_id", "r_regionkey"], "left_anti").select("competitor_id", F.col("r_name").alias("region"))


@query("full_outer_compare", r"""
SELECT COALESCE(a.k, b.k) AS service, CASE WHEN b.k IS NULL THEN 'a_only' WHEN a.k IS NULL THEN 'b_only' ELSE 'shared' END AS side
FROM (SELECT DISTINCT trim(regexp_replace(lower(service_name), '[^a-z0-9]+', ' ', 'g')) k FROM services WHERE competitor_id = 1) a
FULL OUTER JOIN (SELECT DISTINCT trim(regexp_replace(lower(service_name), '[^a-z0-9]+', ' ', 'g')) k FROM services WHERE competitor_id = 2) b ON a.k = b.k""", "services")
def _(spark, d):
    from marketspark.functions.text import normalize

    s = services(spark, d).select("competitor_id", normalize("service_name").alias("service"))
    return R.compare_keyed(s.where("competitor_id = 1"), s.where("competitor_id = 2"), "service")


@query("price_comparison_status", """
WITH m AS (SELECT competitor_id, service_id, avg(CASE WHEN discount >= 0.1 THEN NULL ELSE price END) price FROM pricing GROUP BY 1, 2)
SELECT a.service_id, a.competitor_id AS a, b.competitor_id AS b, CASE WHEN a.price IS NULL THEN 'missing_a' WHEN b.price IS NULL THEN 'missing_b' WHEN a.price = 0 THEN 'zero_base' ELSE 'comparable' END AS status,
CASE WHEN a.price IS NOT NULL AND b.price IS NOT NULL AND a.price <> 0 THEN round(b.price - a.price, 7) END AS diff,
CASE WHEN a.price IS NOT NULL AND b.price IS NOT NULL AND a.price <> 0 THEN round(100 * (b.price - a.price) / a.price, 6) END AS pct
FROM m a JOIN m b ON a.service_id = b.service_id AND a.competitor_id <> b.competitor_id WHERE a.competitor_id = 1""", "pricing")
def _(spark, d):
    m = pricing(spark, d).groupBy("competitor_id", "service_id").agg(F.avg(F.when(F.col("discount") < 0.1, F.col("price"))).alias("price"))
    a, b = (m.select("service_id", F.col("competitor_id").alias(x), F.col("price").alias(f"p{x}")) for x in "ab")
    status = F.when(F.col("pa").isNull(), "missing_a").when(F.col("pb").isNull(), "missing_b").when(F.col("pa") == 0, "zero_base").otherwise("comparable")
    ok = F.col("status") == "comparable"
    # One competitor against all others: its services are the smaller side.
    return a.where("a = 1").join(b.where("b <> 1"), "service_id").withColumn("status", status).select("service_id", "a", "b", "status", F.when(ok, _round(F.col("pb") - F.col("pa"), 7)).alias("diff"), F.when(ok, _round(100 * (F.col("pb") - F.col("pa")) / F.col("pa"), 6)).alias("pct"))


@query("asof_next_observation", """
SELECT e.event_id, e.competitor_id, (SELECT min_by(p.value, (p.ts, p.value)) FROM changes p WHERE p.kind = 'purchase' AND p.competitor_id = e.competitor_id AND p.ts >= e.ts) AS next_value
FROM changes e WHERE e.kind = 'error'""", "changes")
def _(spark, d):
    e = change_events(spark, d)
    left = e.where("kind = 'error'").select("event_id", "competitor_id", "ts")
    return R.asof_next(left, e.where("kind = 'purchase'"), "competitor_id", "ts", "ts", "value").select("event_id", "competitor_id", "next_value")


@query("latest_per_key", "SELECT competitor_id, log_id, day, records FROM logs QUALIFY row_number() OVER (PARTITION BY competitor_id ORDER BY day DESC, log_id DESC) = 1", "logs")
def _(spark, d):
    return R.latest_per_key(collection_logs(spark, d).select("competitor_id", "log_id", "day", "records"), ["competitor_id"], "day", "log_id")


@query("shared_category_pairs", """
WITH s AS (SELECT DISTINCT competitor_id, brand FROM services) SELECT x.competitor_id AS a, y.competitor_id AS b, count(*) AS shared, least(count(*) / 5.0, 1.0)::DOUBLE AS strength
FROM s x JOIN s y ON x.brand = y.brand AND x.competitor_id < y.competitor_id GROUP BY 1, 2""", "services")
def _(spark, d):
    s = services(spark, d).select("competitor_id", "brand").distinct()
    shared = F.least(F.col("shared") / 5.0, F.lit(1.0)).alias("strength")
    return G.sharing(s.select(F.col("competitor_id").alias("member"), F.col("brand").alias("grp"))).select("a", "b", "shared", shared)


@query("period_over_period", """
WITH m AS (SELECT max(day) last FROM pricing), w AS (SELECT category, CASE WHEN day > last - 180 THEN 'recent' WHEN day > last - 360 THEN 'previous' END part, price FROM pricing, m)
SELECT category, round(avg(price) FILTER (part = 'recent'), 4) AS recent, round(avg(price) FILTER (part = 'previous'), 4) AS previous,
round(100 * (avg(price) FILTER (part = 'recent') - avg(price) FILTER (part = 'previous')) / avg(price) FILTER (part = 'previous'), 4) AS change_pct
FROM w GROUP BY 1 HAVING count(*) FILTER (part = 'recent') >= 3 AND count(*) FILTER (part = 'previous') >= 3""", "pricing")
def _(spark, d):
    p = pricing(spark, d)
    p = p.crossJoin(F.broadcast(p.agg(F.max("day").alias("last"))))  # one row
    part = F.when(F.col("day") > F.date_sub("last", 180), "recent").when(F.col("day") > F.date_sub("last", 360), "previous")
    g = p.withColumn("part", part).groupBy("category").agg(*[f(F.when(F.col("part") == x, F.col("price"))).alias(f"{n}_{x}") for x in ("recent", "previous") for n, f in (("m", F.avg), ("n", F.count))])
    return g.where("n_recent >= 3 and n_previous >= 3").select("category", _round(F.col("m_recent")).alias("recent"), _round(F.col("m_previous")).alias("previous"), _round(100 * (F.col("m_recent") - F.col("m_previous")) / F.col("m_previous")).alias("change_pct"))


@query("snapshot_diff", """
WITH a AS (SELECT o_custkey k, max_by(o_orderstatus, (o_orderdate, o_orderkey)) s, count(*) n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
b AS (SELECT o_custkey k, max_by(o_orderstatus, (o_orderdate, o_orderkey)) s, count(*) n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' GROUP BY 1)
SELECT COALESCE(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s OR a.n <> b.n""")
def _(spark, d):
    o = table(spark, d, "orders")

    def snap(part):
        return part.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s"), F.count("*").alias("n"))

    return R.snapshot_diff(snap(o.where("o_orderdate < timestamp_ntz'1996-01-01'")), snap(o.where("o_orderdate >= timestamp_ntz'1995-06-01'")), "o_custkey", ["s", "n"])


@query("children_as_array", """
SELECT competitor_id, name, CAST(len(COALESCE(a, [])) AS BIGINT) AS n, array_to_string(COALESCE(a, []), ',') AS top FROM competitors LEFT JOIN
(SELECT competitor_id, list(service_id ORDER BY price DESC, service_id)[1:5] a FROM services GROUP BY 1) USING (competitor_id)""", "competitors", "services")
def _(spark, d):
    top = R.top_n_per_key(services(spark, d), ["competitor_id"], [F.desc("price"), F.col("service_id")], 5)
    kids = top.groupBy("competitor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "service_id"))), lambda s: s["service_id"].cast("string")).alias("a"))
    a = F.coalesce("a", F.array().cast("array<string>"))
    return competitors(spark, d).join(kids, "competitor_id", "left").select("competitor_id", "name", F.size(a).cast("long").alias("n"), F.array_join(a, ",").alias("top"))


@query("substring_match", """
WITH q AS (SELECT p_partkey, lower(p_name) n FROM part), c AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) w FROM part)
SELECT p_partkey, w AS matched, round(length(w) / length(n)::DOUBLE, 4) AS ratio FROM q JOIN c ON contains(n, w) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(w) / length(n)::DOUBLE DESC, w) = 1""")
def _(spark, d):
    p = table(spark, d, "part")
    words = p.select(F.lower(F.split("p_name", " ")[0]).alias("w")).distinct()
    names = p.select(F.lower("p_name").alias("n")).distinct()  # each name is matched once, however many parts have it
    hit = contained(names.withColumnRenamed("n", "text"), words.withColumnRenamed("w", "name"), []).withColumnsRenamed({"text": "n", "name": "w"}).withColumn("r", F.length("w") / F.length("n").cast("double"))
    best = R.dedup_ordered(hit, ["n"], [F.desc("r"), F.col("w")])
    return p.withColumn("n", F.lower("p_name")).join(best, "n").select("p_partkey", F.col("w").alias("matched"), _round(F.col("r")).alias("ratio"))


@query("grouped_counts", "SELECT o_custkey, o_orderstatus, count(*) AS n, sum(o_totalprice)::DECIMAL(38,2)::DOUBLE AS total FROM orders GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("filtered_counts", """
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS failed, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS large,
COALESCE(round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2), 0) AS pending_value, round(count(*) FILTER (o_orderstatus = 'O') / count(*)::DOUBLE, 6) AS success_rate FROM orders GROUP BY 1""")
def _(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(s == "F").alias("failed"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.coalesce(F.round(F.sum(F.when(s == "P", F.col("o_totalprice"))), 2), F.lit(0.0)).alias("pending_value"), F.round(F.count_if(s == "O") / F.count("*"), 6).alias("success_rate"))


@query("avg_min_max_by_two_keys", "SELECT category, competitor_id, round(avg(price), 4) AS mean, min(price) AS low, max(price) AS high, count(*) AS n FROM pricing GROUP BY 1, 2", "pricing")
def _(spark, d):
    return pricing(spark, d).groupBy("category", "competitor_id").agg(_round(F.avg("price")).alias("mean"), F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("n"))


@query("mean_of_means", "SELECT category, round(avg(m), 4) AS mean, round((max(m) - min(m)) / avg(m), 6) AS spread, count(*) AS competitors FROM (SELECT category, competitor_id, avg(price) m FROM pricing GROUP BY 1, 2) GROUP BY 1", "pricing")
def _(spark, d):
    m = pricing(spark, d).groupBy("category", "competitor_id").agg(F.avg("price").alias("m"))
    return m.groupBy("category").agg(_round(F.avg("m")).alias("mean"), F.round((F.max("m") - F.min("m")) / F.avg("m"), 6).alias("spread"), F.count("*").alias("competitors"))


@query("stddev_cv_by_key", """
SELECT competitor_id, round(stddev_samp(price), 4) AS sd, CASE WHEN count(*) < 2 OR avg(price) = 0 THEN 0 ELSE round(stddev_samp(price) / abs(avg(price)), 6) END AS cv, count(DISTINCT service_id) AS services FROM pricing GROUP BY 1""", "pricing")
def _(spark, d):
    g = pricing(spark, d).groupBy("competitor_id").agg(F.stddev_samp("price").alias("s"), F.avg("price").alias("m"), F.count("*").alias("n"), F.count_distinct("service_id").alias("services"))
    return g.select("competitor_id", _round(F.col("s")).alias("sd"), F.when((F.col("n") < 2) | (F.col("m") == 0), 0.0).otherwise(F.round(F.col("s") / F.abs("m"), 6)).alias("cv"), "services")


@query("z_scores", "SELECT order_id, line, round((price - avg(price) OVER w) / nullif(stddev_samp(price) OVER w, 0), 4) AS z FROM pricing WINDOW w AS (PARTITION BY category)", "pricing")
def _(spark, d):
    p = pricing(spark, d)
    m = p.groupBy("category").agg(F.avg("price").alias("m"), F.stddev_samp("price").alias("s"))  # a row a category: no window over the fact
    return p.join(F.broadcast(m), "category").select("order_id", "line", _round(F.when(F.col("s") != 0, (F.col("price") - F.col("m")) / F.col("s"))).alias("z"))


@query("daily_success_trend", "SELECT day, sum(CASE WHEN success THEN 1 ELSE 0 END)::BIGINT AS ok, sum(CASE WHEN success IS FALSE THEN 1 ELSE 0 END)::BIGINT AS failed, count(*) AS runs FROM logs GROUP BY 1", "logs")
def _(spark, d):
    ok = F.col("success")
    return collection_logs(spark, d).groupBy("day").agg(F.sum(F.coalesce(ok.cast("int"), F.lit(0))).alias("ok"), F.count_if(ok == F.lit(False)).alias("failed"), F.count("*").alias("runs"))


@query("dominance_share", """
SELECT brand, arg_max(competitor_id, (n, -competitor_id)) AS leader, round(max(n) / sum(n)::DOUBLE, 6) AS share FROM (SELECT brand, competitor_id, count(*) n FROM pricing GROUP BY 1, 2) GROUP BY 1""", "pricing")
def _(spark, d):
    n = pricing(spark, d).groupBy("brand", "competitor_id").agg(F.count("*").alias("n"))
    return n.groupBy("brand").agg(F.max_by("competitor_id", F.struct("n", -F.col("competitor_id"))).alias("leader"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("whitespace_categories", """
WITH g AS (SELECT brand, category, count(DISTINCT competitor_id) n FROM services GROUP BY 1, 2), m AS (SELECT avg(n) a FROM g)
SELECT brand, category, n AS competitors FROM g, m WHERE n <= greatest(2, 0.7 * a)""", "services")
def _(spark, d):
    g = services(spark, d).groupBy("brand", "category").agg(F.count_distinct("competitor_id").alias("competitors"))
    return g.crossJoin(F.broadcast(g.agg(F.avg("competitors").alias("a")))).where("competitors <= greatest(2, 0.7 * a)").drop("a")


@query("upper_median_outliers", """
WITH m AS (SELECT service_id, list_sort(list(price))[len(list(price)) // 2 + 1] med, count(*) n FROM pricing GROUP BY 1 HAVING count(*) >= 3)
SELECT p.order_id, p.line, p.price, m.med AS upper_median FROM pricing p JOIN m USING (service_id) WHERE p.price > 1.05 * m.med OR p.price < 0.95 * m.med""", "pricing")
def _(spark, d):
    p = pricing(spark, d)
    m = at_ranks(p, ["service_id"], "price", lambda n: [F.floor(n / 2) + 1]).where("n >= 3").select("service_id", F.col("at")[0].alias("upper_median"))
    return p.join(m, "service_id").where("price > 1.05 * upper_median or price < 0.95 * upper_median").select("order_id", "line", "price", "upper_median")


@query("true_median_by_key", "SELECT service_id, median(price) AS median, min(price) AS low, max(price) AS high, round(avg(price), 4) AS mean FROM pricing GROUP BY 1", "pricing")
def _(spark, d):
    return quantiles(pricing(spark, d), ["service_id"], "price", 0.5).select("service_id", F.col("q")[0].alias("median"), "low", "high", _round(F.col("mean")).alias("mean"))


@query("quartile_tier_spread", """
WITH a AS (SELECT brand, list_sort(list(price)) v FROM pricing GROUP BY 1), q AS (SELECT brand, v[len(v) // 4 + 1] lo, v[3 * len(v) // 4 + 1] hi FROM a)
SELECT p.brand, round(avg(price) FILTER (price <= lo), 4) AS budget, round(avg(price) FILTER (price >= hi), 4) AS premium FROM pricing p JOIN q USING (brand) GROUP BY 1""", "pricing")
def _(spark, d):
    p = pricing(spark, d)
    q = at_ranks(p, ["brand"], "price", lambda n: [F.floor(n / 4) + 1, F.floor(3 * n / 4) + 1]).select("brand", F.col("at")[0].alias("lo"), F.col("at")[1].alias("hi"))
    return p.join(q, "brand").groupBy("brand").agg(_round(F.avg(F.when(F.col("price") <= F.col("lo"), F.col("price")))).alias("budget"), _round(F.avg(F.when(F.col("price") >= F.col("hi"), F.col("price")))).alias("premium"))


@query("percentile_linear", "SELECT category, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.95), 4) AS p95, round(quantile_cont(price, 0.99), 4) AS p99 FROM pricing GROUP BY 1", "pricing")
def _(spark, d):
    q = quantiles(pricing(spark, d).select("category", "price"), ["category"], "price", 0.5, 0.95, 0.99)
    return q.select("category", *[_round(F.col("q")[k]).alias(n) for k, n in enumerate(("p50", "p95", "p99"))])


@query("histogram_last_1000", """
WITH r AS (SELECT value, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) rn, kind FROM changes), a AS (SELECT kind, list_sort(list(value)) v FROM r WHERE rn <= 1000 GROUP BY 1)
SELECT kind, len(v)::BIGINT AS n, v[1] AS low, v[len(v)] AS high, v[len(v) // 2 + 1] AS p50, CASE WHEN len(v) > 20 THEN v[CAST(floor(len(v) * 0.95) AS INT) + 1] END AS p95, CASE WHEN len(v) > 100 THEN v[CAST(floor(len(v) * 0.99) AS INT) + 1] END AS p99 FROM a""", "changes")
def _(spark, d):
    last = R.top_n_per_key(change_events(spark, d), ["kind"], [F.desc("ts"), F.desc("event_id")], 1000)
    a = last.groupBy("kind").agg(F.array_sort(F.collect_list("value")).alias("v")).withColumn("n", F.size("v"))
    return a.selectExpr("kind", "cast(n as bigint) n", "v[0] low", "v[n - 1] high", "v[cast(n div 2 as int)] p50", "case when n > 20 then v[cast(floor(n * 0.95) as int)] end p95", "case when n > 100 then v[cast(floor(n * 0.99) as int)] end p99")


@query("json_text_search", "SELECT event_id, kind, props FROM changes WHERE contains(lower(props), '\"k\": 7') AND kind ILIKE '%purch%'", "changes")
def _(spark, d):
    return change_events(spark, d).where(R.contains("props", '"k": 7') & F.col("kind").ilike("%purch%")).select("event_id", "kind", "props")


@query("json_field_agg", "SELECT kind, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS latest, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM changes GROUP BY 1", "changes")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return change_events(spark, d).withColumn("k", k).groupBy("kind").agg(F.max("k").alias("top"), F.max_by("k", F.struct("ts", "event_id")).alias("latest"), F.sum("k").alias("total"))


@query("drop_rate_price_war", """
WITH s AS (SELECT category, day, avg(price) m FROM pricing GROUP BY 1, 2), x AS (SELECT category, CASE WHEN m < lag(m) OVER (PARTITION BY category ORDER BY day) THEN 1 ELSE 0 END drop_, lag(m) OVER (PARTITION BY category ORDER BY day) p FROM s)
SELECT category, round(sum(drop_) / count(p)::DOUBLE, 6) AS drop_rate, count(*) >= 4 AND sum(drop_) / count(p)::DOUBLE > 0.4 AS price_war FROM x GROUP BY 1""", "pricing")
def _(spark, d):
    s = pricing(spark, d).groupBy("category", "day").agg(F.avg("price").alias("m"))
    s = s.withColumn("p", F.lag("m").over(Window.partitionBy("category").orderBy("day")))
    g = s.groupBy("category").agg((F.count_if(F.col("m") < F.col("p")) / F.count("p")).alias("r"), F.count("*").alias("n"))
    return g.select("category", F.round("r", 6).alias("drop_rate"), ((F.col("n") >= 4) & (F.col("r") > 0.4)).alias("price_war"))


@query("top_n_per_group", "SELECT competitor_id, order_id, line, price, row_number() OVER (PARTITION BY competitor_id ORDER BY price DESC NULLS LAST, order_id, line) AS rank FROM pricing QUALIFY rank <= 5", "pricing")
def _(spark, d):
    return R.top_n_per_key(pricing(spark, d).select("competitor_id", "order_id", "line", "price"), ["competitor_id"], [F.desc_nulls_last("price"), F.col("order_id"), F.col("line")], 5).withColumn("rank", F.col("rank").cast("long"))


@query("capped_groups_top15", """
WITH r AS (SELECT category, brand, count(*) n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, brand) rn FROM pricing GROUP BY 1, 2) SELECT category, brand, n FROM r WHERE rn <= 5 ORDER BY n DESC, category, brand LIMIT 15""", "pricing")
def _(spark, d):
    g = pricing(spark, d).groupBy("category", "brand").agg(F.count("*").alias("n"))
    return R.top_n_per_key(g, ["category"], [F.desc("n"), F.col("brand")], 5).orderBy(F.desc("n"), "category", "brand").limit(15).drop("rank")


@query("top_n_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("paginate_with_total", """
SELECT log_id, competitor_id, day, (SELECT count(*) FROM logs WHERE success) AS total, CAST(ceil((SELECT count(*) FROM logs WHERE success) / 25.0) AS BIGINT) AS pages FROM logs WHERE success ORDER BY day DESC, log_id DESC LIMIT 25 OFFSET 50""", "logs")
def _(spark, d):
    ok = collection_logs(spark, d).where("success")
    total = ok.agg(F.count("*").alias("total"))  # one row
    return R.page(ok, [F.desc("day"), F.desc("log_id")], 50, 25).select("log_id", "competitor_id", "day").crossJoin(total).withColumn("pages", F.ceil(F.col("total") / 25.0))


@query("merged_feed", """
SELECT * FROM (SELECT 'run' AS kind, o_orderkey AS id, o_orderdate AS moment FROM orders UNION ALL SELECT 'change', event_id, ts FROM events) ORDER BY moment DESC, kind, id DESC LIMIT 100""")
def _(spark, d):
    runs = table(spark, d, "orders").select(F.lit("run").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment"))
    changes = table(spark, d, "events").select(F.lit("change").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("moment"))
    return R.merged_feed([runs, changes], [F.desc("moment"), F.col("kind"), F.desc("id")], 100)


@query("distinct_lists", "SELECT competitor_id, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM services GROUP BY 1", "services")
def _(spark, d):
    return services(spark, d).groupBy("competitor_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


@query("alert_rates", """
WITH h AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) n, count(*) FILTER (kind = 'error') e FROM changes GROUP BY 1) SELECT hour, n, e AS errors, round(e / n::DOUBLE, 6) AS rate, e / n::DOUBLE > 0.2 AS failing, e > 5 AS stalled FROM h""", "changes")
def _(spark, d):
    h = change_events(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "error").alias("errors"))
    r = F.col("errors") / F.col("n")
    return h.select("hour", "n", "errors", F.round(r, 6).alias("rate"), (r > 0.2).alias("failing"), (F.col("errors") > 5).alias("stalled"))


@query("bool_null_in_range_filters", """
SELECT log_id, success FROM logs WHERE (success IS TRUE OR success IS NULL) AND competitor_id IN (1, 2, 3, 5, 8, 13) AND day >= DATE '1994-01-01' AND day < DATE '1997-01-01' AND records IS NOT NULL""", "logs")
def _(spark, d):
    o = collection_logs(spark, d)
    return o.where((F.col("success").eqNullSafe(True) | F.col("success").isNull()) & F.col("competitor_id").isin(1, 2, 3, 5, 8, 13) & (F.col("day") >= F.lit("1994-01-01").cast("date")) & (F.col("day") < F.lit("1997-01-01").cast("date")) & F.col("records").isNotNull()).select("log_id", "success")


@query("dynamic_filters", "SELECT competitor_id, name, nation FROM competitors WHERE enabled AND contains(lower(name), '1') AND region = 'ASIA'", "competitors")
def _(spark, d):
    asked = {"enabled": True, "search": "1", "region": "ASIA", "nation": None}
    f = [F.col("enabled") == asked["enabled"] if asked["enabled"] is not None else None, R.contains("name", asked["search"]) if asked["search"] else None, *[F.col(c) == asked[c] if asked[c] is not None else None for c in ("region", "nation")]]
    return R.where_all(competitors(spark, d), *f).select("competitor_id", "name", "nation")


@query("upsert_latest", """
WITH b AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders) SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return R.upsert_latest(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 <> 0"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("upsert_touch", """
WITH p AS (SELECT competitor_id, service_id, day, price, year(day) < 1996 AS early FROM pricing), o AS (SELECT competitor_id, service_id, max(day) AS day, max(price) AS price FROM p WHERE early GROUP BY 1, 2), n AS (SELECT competitor_id, service_id, max(day) AS day, max(price) AS price FROM p WHERE NOT early GROUP BY 1, 2)
SELECT COALESCE(o.competitor_id, n.competitor_id) AS competitor_id, COALESCE(o.service_id, n.service_id) AS service_id, greatest(o.day, n.day) AS day, COALESCE(o.price, n.price) AS price FROM o FULL OUTER JOIN n ON o.competitor_id = n.competitor_id AND o.service_id = n.service_id""", "pricing")
def _(spark, d):
    p = pricing(spark, d).groupBy("competitor_id", "service_id", (F.year("day") < 1996).alias("old")).agg(F.max("day").alias("day"), F.max("price").alias("price"))
    return R.upsert_touch(p.where("old").drop("old"), p.where("not old").drop("old"), ["competitor_id", "service_id"], "day")


@query("upsert_map_merge", """
WITH e AS (SELECT competitor_id, kind, day, max(value) v FROM changes GROUP BY 1, 2, 3), o AS (SELECT competitor_id, kind, max(v) v FROM e WHERE day < DATE '2024-01-16' GROUP BY 1, 2), n AS (SELECT competitor_id, kind, max(v) v FROM e WHERE day >= DATE '2024-01-16' GROUP BY 1, 2)
SELECT COALESCE(o.competitor_id, n.competitor_id) AS competitor_id, COALESCE(o.kind, n.kind) AS kind, COALESCE(n.v, o.v) AS v FROM o FULL OUTER JOIN n ON o.competitor_id = n.competitor_id AND o.kind = n.kind""", "changes")
def _(spark, d):
    e = change_events(spark, d)

    def maps(part):
        g = part.groupBy("competitor_id", "kind").agg(F.max("value").alias("v"))
        return g.groupBy("competitor_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "v"))).alias("m"))

    cut = F.lit("2024-01-16").cast("date")
    return R.merge_maps(maps(e.where(F.col("day") < cut)), maps(e.where(F.col("day") >= cut)), "competitor_id", "m").select("competitor_id", F.explode("m").alias("kind", "v"))


@query("ordered_dedup", "SELECT competitor_id, kind, event_id FROM changes QUALIFY row_number() OVER (PARTITION BY competitor_id, kind ORDER BY ts, event_id) = 1", "changes")
def _(spark, d):
    return R.dedup_ordered(change_events(spark, d).select("competitor_id", "kind", "event_id", "ts"), ["competitor_id", "kind"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("fk_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def _(spark, d):
    return R.orphans(table(spark, d, "orders"), table(spark, d, "customer").where("c_custkey % 7 <> 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("due_runs", """
WITH l AS (SELECT competitor_id, max_by(day, (day, log_id)) last, arg_max_null(success, (day, log_id)) ok FROM logs GROUP BY 1), f AS (SELECT competitor_id, last, ok, CASE competitor_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 30 END every FROM l), a AS (SELECT max(day) now_ FROM logs)
SELECT competitor_id, last AS last_run, ok IS NOT TRUE OR last + every <= now_ AS due FROM f, a""", "logs")
def _(spark, d):
    o = collection_logs(spark, d)
    last = o.groupBy("competitor_id").agg(F.max(F.struct("day", "log_id", "success")).alias("l"))
    every = F.when(F.col("competitor_id") % 3 == 0, 1).when(F.col("competitor_id") % 3 == 1, 7).otherwise(30)
    now = o.agg(F.max("day").alias("now_"))
    due = ~F.col("l.success").eqNullSafe(True) | (F.date_add("l.day", every) <= F.col("now_"))
    return last.crossJoin(F.broadcast(now)).select("competitor_id", F.col("l.day").alias("last_run"), due.alias("due"))


@query("csv_export_rows", """
SELECT c.name, COALESCE(p.category, 'none') AS category, COALESCE(p.n, 0) AS prices, p.mean FROM competitors c LEFT JOIN (SELECT competitor_id, category, count(*) n, round(avg(price), 2) mean FROM pricing WHERE price > 1490 GROUP BY 1, 2) p USING (competitor_id)""", "competitors", "pricing")
def _(spark, d):
    p = pricing(spark, d).where("price > 1490").groupBy("competitor_id", "category").agg(F.count("*").alias("prices"), F.round(F.avg("price"), 2).alias("mean"))
    return competitors(spark, d).join(p, "competitor_id", "left").select("name", F.coalesce("category", F.lit("none")).alias("category"), F.coalesce("prices", F.lit(0)).alias("prices"), "mean")
