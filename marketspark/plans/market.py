"""Scores, quality, risks, opportunities, recommendations, simulations, geography and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketspark.operators import graph as G
from marketspark.operators.selection import at_ranks
from marketspark.operators import relational as R
from marketspark.operators.series import clamp
from marketspark.plans.registry import QUERIES, query
from marketspark.sources.tables import change_events, collection_logs, competitors, pricing, services, table

_METRICS = """m AS (SELECT c.competitor_id, COALESCE(s.n, 0) AS services, COALESCE(s.k, 0) AS brands, COALESCE(p.n, 0) AS prices, p.mean, p.sd, COALESCE(g.n, 0) AS changes, COALESCE(l.n, 0) AS runs, COALESCE(l.ok, 0) AS ok FROM competitors c
LEFT JOIN (SELECT competitor_id, count(*) n, count(DISTINCT brand) k FROM services GROUP BY 1) s USING (competitor_id) LEFT JOIN (SELECT competitor_id, count(*) n, avg(price) mean, stddev_samp(price) sd FROM pricing GROUP BY 1) p USING (competitor_id)
LEFT JOIN (SELECT competitor_id, count(*) n FROM changes GROUP BY 1) g USING (competitor_id) LEFT JOIN (SELECT competitor_id, count(*) n, count(*) FILTER (success) ok FROM logs GROUP BY 1) l USING (competitor_id))"""
_V = ("competitors", "services", "pricing", "changes", "logs")


def metrics(spark, d):
    """A row a competitor: counts of each fact, aggregated before they meet."""
    s = services(spark, d).groupBy("competitor_id").agg(F.count("*").alias("services"), F.count_distinct("brand").alias("brands"))
    p = pricing(spark, d).groupBy("competitor_id").agg(F.count("*").alias("prices"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("sd"))
    g = change_events(spark, d).groupBy("competitor_id").agg(F.count("*").alias("changes"))
    o = collection_logs(spark, d).groupBy("competitor_id").agg(F.count("*").alias("runs"), F.count_if("success").alias("ok"))
    out = competitors(spark, d).select("competitor_id")
    for x in (s, p, g, o):
        out = out.join(x, "competitor_id", "left")
    return out.na.fill(0, ["services", "brands", "prices", "changes", "runs", "ok"])


@query("avg_of_ranks", f"""
WITH {_METRICS}, r AS (SELECT competitor_id, row_number() OVER (ORDER BY services DESC, competitor_id) - 1 a, row_number() OVER (ORDER BY prices DESC, competitor_id) - 1 b, row_number() OVER (ORDER BY changes DESC, competitor_id) - 1 c, row_number() OVER (ORDER BY runs DESC, competitor_id) - 1 e FROM m)
SELECT competitor_id, (a + b + c + e) / 4.0::DOUBLE AS mean_rank, CAST(round((a + b + c + e) / 4.0::DOUBLE + 1) AS BIGINT) AS position FROM r""", *_V)
def _(spark, d):
    m = metrics(spark, d)
    ranks = [F.row_number().over(Window.orderBy(F.desc(c), "competitor_id")) - 1 for c in ("services", "prices", "changes", "runs")]
    return m.select("competitor_id", (sum(ranks[1:], ranks[0]) / 4.0).alias("mean_rank")).withColumn("position", F.round(F.col("mean_rank") + 1).cast("long"))


@query("record_state", f"WITH {_METRICS} SELECT competitor_id, CASE WHEN runs = 0 AND prices = 0 THEN 'NO_DATA' WHEN runs > 0 AND ok = 0 THEN 'FAILED' WHEN runs < 5 THEN 'STALE' ELSE 'VALID' END AS state FROM m", *_V)
def _(spark, d):
    state = F.when((F.col("runs") == 0) & (F.col("prices") == 0), "NO_DATA").when((F.col("runs") > 0) & (F.col("ok") == 0), "FAILED").when(F.col("runs") < 5, "STALE").otherwise("VALID")
    return metrics(spark, d).select("competitor_id", state.alias("state"))


@query("price_conflict_resolution", """
WITH u AS (SELECT service_id, list_sort(list(price))[len(list(price)) // 2 + 1] med FROM pricing GROUP BY 1), k AS (SELECT p.* FROM pricing p JOIN u USING (service_id) WHERE price <= 5 * med AND price >= 0.1 * med)
SELECT service_id, count(*) AS kept, arg_max(price, (discount >= 0.1, day, order_id, line)) AS resolved FROM k GROUP BY 1""", "pricing")
def _(spark, d):
    p = pricing(spark, d)
    u = at_ranks(p, ["service_id"], "price", lambda n: [F.floor(n / 2) + 1]).select("service_id", F.col("at")[0].alias("med"))
    return p.join(u, "service_id").where("price <= 5 * med and price >= 0.1 * med").groupBy("service_id").agg(F.count("*").alias("kept"), F.max_by("price", F.struct(F.col("discount") >= 0.1, "day", "order_id", "line")).alias("resolved"))


@query("benchmark_matrix", """
WITH m AS (SELECT category, median(mean) med, min(mean) low, max(mean) high FROM (SELECT category, competitor_id, avg(price) mean FROM pricing GROUP BY 1, 2) GROUP BY 1), o AS (SELECT category, avg(price) own FROM pricing WHERE competitor_id = 1 GROUP BY 1)
SELECT category, round(own, 4) AS own, round(med, 4) AS median, round(100 * (own - med) / med, 4) AS gap_pct, round(100 * own / med, 4) AS price_index, CASE WHEN own < low THEN 'lowest' WHEN own < med THEN 'below' WHEN own <= high THEN 'above' ELSE 'highest' END AS position FROM o JOIN m USING (category)""", "pricing")
def _(spark, d):
    p = pricing(spark, d)
    m = p.groupBy("category", "competitor_id").agg(F.avg("price").alias("mean")).groupBy("category").agg(F.median("mean").alias("med"), F.min("mean").alias("low"), F.max("mean").alias("high"))
    own, med = F.col("own"), F.col("med")
    pos = F.when(own < F.col("low"), "lowest").when(own < med, "below").when(own <= F.col("high"), "above").otherwise("highest")
    return p.where("competitor_id = 1").groupBy("category").agg(F.avg("price").alias("own")).join(m, "category").select("category", F.round(own, 4).alias("own"), F.round(med, 4).alias("median"), F.round(100 * (own - med) / med, 4).alias("gap_pct"), F.round(100 * own / med, 4).alias("price_index"), pos.alias("position"))


@query("opportunities_top15", """
WITH g AS (SELECT 'pricing_gap' kind, category || '/' || brand AS subject, (max(m) - min(m)) / avg(m) AS score FROM (SELECT category, brand, competitor_id, avg(price) m FROM pricing GROUP BY 1, 2, 3) GROUP BY 2), w AS (SELECT 'whitespace', category || '/' || brand, 1.0 / count(DISTINCT competitor_id) FROM services GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, subject) rn FROM (SELECT * FROM g UNION ALL SELECT * FROM w)) SELECT kind, subject, round(score, 6) AS score FROM r WHERE rn <= 10 ORDER BY round(score, 6) DESC, kind, subject LIMIT 15""", "pricing", "services")
def _(spark, d):
    name = F.concat_ws("/", "category", "brand").alias("subject")
    m = pricing(spark, d).groupBy("category", "brand", "competitor_id").agg(F.avg("price").alias("m"))
    g = m.groupBy(name).agg(((F.max("m") - F.min("m")) / F.avg("m")).alias("score")).withColumn("kind", F.lit("pricing_gap"))
    w = services(spark, d).groupBy(name).agg((1.0 / F.count_distinct("competitor_id")).alias("score")).withColumn("kind", F.lit("whitespace"))
    top = R.top_n_per_key(g.unionByName(w), ["kind"], [F.desc("score"), F.col("subject")], 10)
    return top.select("kind", "subject", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "kind", "subject").limit(15)


@query("recommendations_top8", f"""
WITH {_METRICS}, a AS (SELECT avg(mean) p, avg(services) s FROM m), x AS (SELECT competitor_id, 'lower_prices' AS action, (mean - p) / p AS weight FROM m, a WHERE mean > 1.05 * p UNION ALL SELECT competitor_id, 'add_services', (s - services) / s FROM m, a WHERE services < 0.95 * s UNION ALL SELECT competitor_id, 'fix_collection', 1 - ok / runs::DOUBLE FROM m WHERE runs > 0 AND ok / runs::DOUBLE < 0.5)
SELECT competitor_id, action, round(weight, 6) AS weight FROM x QUALIFY row_number() OVER (PARTITION BY action ORDER BY weight DESC, competitor_id) <= 8""", *_V)
def _(spark, d):
    m = metrics(spark, d)
    m = m.crossJoin(F.broadcast(m.agg(F.avg("mean").alias("p"), F.avg("services").alias("s"))))
    rate = F.col("ok") / F.col("runs")
    rule = lambda n, w, c: F.when(c, F.struct(F.lit(n).alias("action"), w.alias("weight")))
    every = F.array(rule("lower_prices", (F.col("mean") - F.col("p")) / F.col("p"), F.col("mean") > 1.05 * F.col("p")), rule("add_services", (F.col("s") - F.col("services")) / F.col("s"), F.col("services") < 0.95 * F.col("s")), rule("fix_collection", 1 - rate, (F.col("runs") > 0) & (rate < 0.5)))
    x = m.select("competitor_id", F.explode(F.filter(every, lambda r: r.isNotNull())).alias("r")).select("competitor_id", "r.action", "r.weight")
    return R.top_n_per_key(x, ["action"], [F.desc("weight"), F.col("competitor_id")], 8).select("competitor_id", "action", F.round("weight", 6).alias("weight"))


@query("scenario_price_war", """
WITH p AS (SELECT avg(price) mean, count(DISTINCT competitor_id) n FROM pricing) SELECT cut, round(mean * (1 - cut), 4) AS new_price, round(cut * 1.5 * 100, 4) AS volume_pct, round(100 * ((1 - cut) * (1 + 1.5 * cut) - 1), 4) AS revenue_pct, least(n, CAST(ceil(n * cut) AS BIGINT)) AS followers
FROM p, (SELECT unnest([0.05, 0.1, 0.2, 0.3]::DOUBLE[]) cut)""", "pricing")
def _(spark, d):
    p = pricing(spark, d).agg(F.avg("price").alias("mean"), F.count_distinct("competitor_id").alias("n"))
    c = F.col("cut")
    return p.withColumn("cut", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.2, 0.3)]))).select("cut", F.round(F.col("mean") * (1 - c), 4).alias("new_price"), F.round(c * 1.5 * 100, 4).alias("volume_pct"), F.round(100 * ((1 - c) * (1 + 1.5 * c) - 1), 4).alias("revenue_pct"), F.least("n", F.ceil(F.col("n") * c)).alias("followers"))


@query("expansion_probability", """
WITH c AS (SELECT nation, count(*) n FROM competitors GROUP BY 1), d AS (SELECT n_name, r_name, count(c_custkey) demand FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_name AS nation, COALESCE(n, 0) AS present, demand, round(least(1, 0.2 + 0.5 * demand / (SELECT max(demand) FROM d) + CASE WHEN COALESCE(n, 0) = 0 THEN 0.3 ELSE 0 END), 6) AS probability FROM d LEFT JOIN c ON c.nation = d.n_name""", "competitors")
def _(spark, d):
    n, cu = table(spark, d, "nation"), table(spark, d, "customer")
    demand = n.join(cu.groupBy("c_nationkey").agg(F.count("*").alias("k")), n.n_nationkey == F.col("c_nationkey"), "left").select(F.col("n_name").alias("nation"), F.coalesce("k", F.lit(0)).alias("demand"))
    have = competitors(spark, d).groupBy("nation").agg(F.count("*").alias("present"))
    top = demand.agg(F.max("demand").alias("top"))
    x = demand.join(have, "nation", "left").na.fill(0, ["present"]).crossJoin(F.broadcast(top))
    return x.select("nation", "present", "demand", F.round(clamp(0.2 + 0.5 * F.col("demand") / F.col("top") + F.when(F.col("present") == 0, 0.3).otherwise(0.0)), 6).alias("probability"))


@query("geo_saturation", """
SELECT r_name AS region, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS competitors, round(count(DISTINCT s_suppkey) / greatest(count(DISTINCT c_custkey), 1)::DOUBLE, 6) AS saturation FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def _(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    g = n.join(r, n.n_regionkey == r.r_regionkey).join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").groupBy(F.col("r_name").alias("region")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("customers"), F.coalesce(F.sum("s"), F.lit(0)).alias("competitors"))
    return g.withColumn("saturation", F.round(F.col("competitors") / F.greatest("customers", F.lit(1)), 6))


@query("feedback_summary", "SELECT count(*) AS n, count(*) FILTER (quality = 1) AS approved, round(count(*) FILTER (quality = 1) / count(*)::DOUBLE, 6) AS rate FROM labels")
def _(spark, d):
    return table(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("approved"), F.round(F.count_if(F.col("quality") == 1) / F.count("*"), 6).alias("rate"))


@query("token_cost", "SELECT conv_id, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::BIGINT AS chars_in, sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END)::BIGINT AS chars_out, round((0.15 * sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) + 0.60 * sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END)) / 1e6, 9) AS cost FROM conversations GROUP BY 1")
def _(spark, d):
    n, user = F.length("text"), F.col("role") == "user"
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(user, n).otherwise(0)).cast("long").alias("chars_in"), F.sum(F.when(~user, n).otherwise(0)).cast("long").alias("chars_out"))
    return g.withColumn("cost", F.round((0.15 * F.col("chars_in") + 0.60 * F.col("chars_out")) / 1e6, 9))


@query("learned_weights", "SELECT kind, round(sum((least(1, value / 100) - 0.5) * 0.1), 4) AS adjustment, count(*) AS outcomes FROM changes GROUP BY 1", "changes")
def _(spark, d):
    return change_events(spark, d).groupBy("kind").agg(F.round(F.sum((F.least(F.lit(1.0), F.col("value") / 100) - 0.5) * 0.1), 4).alias("adjustment"), F.count("*").alias("outcomes"))


@query("radar_normalize", f"WITH {_METRICS} SELECT competitor_id, x.metric, round(100 * x.v / greatest(max(x.v) OVER (PARTITION BY x.metric), 1)::DOUBLE, 2) AS score FROM (SELECT competitor_id, unnest(['services', 'prices', 'changes']) metric, unnest([services, prices, changes]) v FROM m) x", *_V)
def _(spark, d):
    m = metrics(spark, d)
    long = m.unpivot(["competitor_id"], ["services", "prices", "changes"], "metric", "v")
    top = long.groupBy("metric").agg(F.greatest(F.max("v"), F.lit(1)).alias("top"))
    return long.join(F.broadcast(top), "metric").select("competitor_id", "metric", F.round(100 * F.col("v") / F.col("top"), 2).alias("score"))


@query("horizon_table", "SELECT category, h AS horizon, round(avg(price) * (1 + 0.0005 * h), 4) AS predicted FROM pricing, (SELECT unnest([30, 60, 90, 180]) h) GROUP BY 1, 2", "pricing")
def _(spark, d):
    g = pricing(spark, d).groupBy("category").agg(F.avg("price").alias("m"))
    return g.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (30, 60, 90, 180)]))).select("category", "horizon", F.round(F.col("m") * (1 + 0.0005 * F.col("horizon")), 4).alias("predicted"))


def _links(spark, d):
    """For each competitor the greater ones that offer a common service. Repeated offers are left to the groups' sets, which takes
    one shuffle less."""
    offers = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("member"), F.col("l_partkey").alias("grp"))
    return G.linked(offers.join(table(spark, d, "part").select(F.col("p_partkey").alias("grp")), "grp", "left_semi"))


_EDGES = "e AS (SELECT DISTINCT a.competitor_id src, b.competitor_id dst FROM services a JOIN services b ON a.service_id = b.service_id AND a.competitor_id < b.competitor_id)"


@query("graph_edges", """SELECT 'offers' AS rel, competitor_id AS src, service_id AS dst FROM services UNION ALL SELECT DISTINCT 'in_nation', competitor_id, (SELECT n.n_nationkey::BIGINT FROM nation n WHERE n.n_name = competitors.nation) FROM competitors""", "services", "competitors")
def _(spark, d):
    n = table(spark, d, "nation")
    offers = services(spark, d).select(F.lit("offers").alias("rel"), F.col("competitor_id").alias("src"), F.col("service_id").alias("dst"))
    where = competitors(spark, d).join(n, F.col("nation") == n.n_name).select(F.lit("in_nation").alias("rel"), F.col("competitor_id").alias("src"), F.col("n_nationkey").cast("long").alias("dst"))
    return offers.unionByName(where)


@query("connected_components", f"WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS node, src AS reach FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON r.reach = b.src) SELECT node, min(reach) AS component FROM r GROUP BY 1", "services")
def _(spark, d):
    # Over competitors and services, which takes an edge an offer; services come after all competitors.
    s = services(spark, d).select(F.col("competitor_id").alias("src"), (F.col("service_id") + F.lit(1 << 40)).alias("dst"))
    shared = s.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst")
    return G.components(s.join(shared, "dst").select("src", "dst")).where(F.col("node") < 1 << 40)


@query("bfs_path", f"WITH RECURSIVE {_EDGES}, r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < 5) SELECT node, min(depth) AS depth FROM r GROUP BY 1", "services")
def _(spark, d):
    return G.hops(services(spark, d).select(F.col("competitor_id").alias("member"), F.col("service_id").alias("grp")), 1)


@query("influence_scores")
def _(spark, d):
    return G.influence(_links(spark, d))


@query("hidden_pairs", f"""WITH {_EDGES}, s AS (SELECT competitor_id, brand, count(*) n FROM services GROUP BY 1, 2 HAVING count(*) >= 3) SELECT a.competitor_id AS a, b.competitor_id AS b, count(*) AS shared FROM s a JOIN s b ON a.brand = b.brand AND a.competitor_id < b.competitor_id
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = a.competitor_id AND e.dst = b.competitor_id) GROUP BY 1, 2 HAVING count(*) >= 2""", "services")
def _(spark, d):
    s = services(spark, d).groupBy("competitor_id", "brand").count().where("count >= 3")
    return G.sharing(s.select(F.col("competitor_id").alias("member"), F.col("brand").alias("grp")), _links(spark, d)).where("shared >= 2")


@query(
    "neighbors",
    """SELECT 'out' AS direction, 'offers' AS rel, service_id::BIGINT AS node FROM services WHERE competitor_id = 1 UNION ALL SELECT 'out', 'in_nation', n_nationkey::BIGINT FROM competitors JOIN nation ON nation = n_name WHERE competitor_id = 1
UNION ALL SELECT 'in', 'offers', competitor_id FROM services WHERE service_id = 1""",
    "services",
    "competitors",
)
def _(spark, d):
    """Neighbours of competitor 1, and what service 1 is a neighbour of."""
    edges = QUERIES["graph_edges"](spark, d)
    return G.neighbors(edges, 1).unionByName(G.neighbors(edges, 1, reverse=True, rel="offers"))


@query(
    "category_2hop",
    """SELECT 'category' AS by_, category AS place, count(DISTINCT competitor_id) AS competitors, min(competitor_id) AS first FROM services GROUP BY 2
UNION ALL SELECT 'nation', nation, count(*), min(competitor_id) FROM competitors GROUP BY 2""",
    "services",
    "competitors",
)
def _(spark, d):
    n, first = F.count_distinct("competitor_id").alias("competitors"), F.min("competitor_id").alias("first")
    a = services(spark, d).groupBy(F.col("category").alias("place")).agg(n, first).select(F.lit("category").alias("by_"), "place", "competitors", "first")
    b = competitors(spark, d).groupBy(F.col("nation").alias("place")).agg(n, first).select(F.lit("nation").alias("by_"), "place", "competitors", "first")
    return a.unionByName(b)


_NODES = "nodes AS (SELECT 'competitor' AS type, competitor_id AS id, name FROM competitors UNION ALL SELECT 'service', p_partkey, p_name FROM part UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation)"


def _nodes(spark, d):
    c = competitors(spark, d).select(F.lit("competitor").alias("type"), F.col("competitor_id").alias("id"), "name")
    p = table(spark, d, "part").select(F.lit("service").alias("type"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    n = table(spark, d, "nation").select(F.lit("nation").alias("type"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return c.unionByName(p).unionByName(n)


@query("node_search", f"WITH {_NODES} SELECT type, id, name FROM nodes WHERE contains(lower(name), 'an') ORDER BY type, id LIMIT 20", "competitors")
def _(spark, d):
    return _nodes(spark, d).where(F.contains(F.lower("name"), F.lit("an"))).orderBy("type", "id").limit(20)


@query("graph_stats", f"WITH {_NODES} SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', 'offers', count(*) FROM services UNION ALL SELECT 'edge', 'in_nation', count(*) FROM competitors", "competitors", "services")
def _(spark, d):
    nodes = _nodes(spark, d).groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    edges = QUERIES["graph_edges"](spark, d).groupBy(F.col("rel").alias("type")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n")
    return nodes.unionByName(edges)


@query(
    "graph_paths",
    """WITH o AS (SELECT DISTINCT competitor_id, service_id FROM services), h AS (SELECT b.competitor_id AS dst, min(a.service_id) AS via FROM o a JOIN o b ON a.service_id = b.service_id WHERE a.competitor_id = 1 AND b.competitor_id > 1 GROUP BY 1)
SELECT dst, via, '1>' || via || '>' || dst AS path FROM h""",
    "services",
)
def _(spark, d):
    """Competitor 1's shortest paths of two edges over the service of least id."""
    s = services(spark, d).select("competitor_id", "service_id")
    near = s.where("competitor_id = 1").select("service_id").join(s.where("competitor_id > 1"), "service_id")
    near = near.groupBy(F.col("competitor_id").alias("dst")).agg(F.min("service_id").alias("via"))
    return near.withColumn("path", F.concat(F.lit("1>"), "via", F.lit(">"), "dst"))


@query(
    "geo_outlook",
    """WITH c AS (SELECT c_nationkey k, count(*) demand, avg(c_acctbal) wealth FROM customer GROUP BY 1), s AS (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1),
g AS (SELECT n_name AS nation, r_name AS region, COALESCE(demand, 0) AS demand, COALESCE(n, 0) AS present, COALESCE(wealth, 0) AS wealth FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey)
SELECT nation, region, present, round(present / greatest(demand, 1)::DOUBLE, 6) AS saturation, round((1 - present / (SELECT max(present) FROM g)::DOUBLE) * demand / (SELECT max(demand) FROM g), 6) AS opportunity,
round(demand / (SELECT sum(demand) FROM g)::DOUBLE, 6) AS coverage, round(wealth, 1) AS wealth, CAST(demand // 50 AS BIGINT) AS capacity, present > (SELECT avg(present) FROM g) AS hot,
row_number() OVER (PARTITION BY region ORDER BY demand DESC, nation) AS path_place FROM g""",
)
def _(spark, d):
    """A row a nation: saturation, opportunity, coverage, capacity, whether it is hot on the map, and its place among its
    region's nations on the way of an expansion."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("demand"), F.avg("c_acctbal").alias("wealth"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("present"))
    g = n.join(r, n.n_regionkey == r.r_regionkey).join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").na.fill(0, ["demand", "present", "wealth"])
    top = g.agg(F.max("present").alias("mp"), F.max("demand").alias("md"), F.sum("demand").alias("sd"), F.avg("present").alias("ap"))
    place = F.row_number().over(Window.partitionBy("r_name").orderBy(F.desc("demand"), "n_name"))
    return g.crossJoin(F.broadcast(top)).select(
        F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "present", F.round(F.col("present") / F.greatest("demand", F.lit(1)), 6).alias("saturation"),
        F.round((1 - F.col("present") / F.col("mp")) * F.col("demand") / F.col("md"), 6).alias("opportunity"), F.round(F.col("demand") / F.col("sd"), 6).alias("coverage"),
        F.round("wealth", 1).alias("wealth"), F.floor(F.col("demand") / 50).alias("capacity"), (F.col("present") > F.col("ap")).alias("hot"), place.cast("long").alias("path_place"),
    )


@query(
    "city_assignment",
    """WITH m AS (SELECT competitor_id, n_name AS city FROM competitors JOIN nation ON contains(name, '0' || n_nationkey) WHERE enabled)
SELECT competitor_id, city, false AS is_default FROM m UNION ALL SELECT competitor_id, unnest(['NATION_0', 'NATION_1', 'NATION_2', 'NATION_3']), true FROM competitors WHERE competitor_id NOT IN (SELECT competitor_id FROM m)""",
    "competitors",
)
def _(spark, d):
    """Where a competitor is: places that its own names; where none does, four default ones, marked as such."""
    c, n = competitors(spark, d), table(spark, d, "nation")
    hit = c.where("enabled").join(F.broadcast(n), F.contains(F.col("name"), F.concat(F.lit("0"), F.col("n_nationkey").cast("string"))))  # 25 nations
    hit = hit.select("competitor_id", F.col("n_name").alias("city"), F.lit(False).alias("is_default"))
    rest = c.select("competitor_id").join(hit, "competitor_id", "left_anti")
    return hit.unionByName(rest.select("competitor_id", F.explode(F.array(*[F.lit(x) for x in ("NATION_0", "NATION_1", "NATION_2", "NATION_3")])).alias("city"), F.lit(True).alias("is_default")))
