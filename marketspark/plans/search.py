"""Retrieval, url helpers, changes of rows, retries and visual change."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketspark.functions.urls import TRACKING, canonical_link, is_tracking
from marketspark.operators import relational as R
from marketspark.operators import retrieval
from marketspark.plans.registry import query
from marketspark.sources.tables import change_events, competitors, pricing, table

_TRACK = "[" + ", ".join(f"'{t}'" for t in TRACKING) + "]"


@query("url_helpers", rf"SELECT page_id, list_has_any(list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: lower(string_split(x, '=')[1])), {_TRACK}) AS tracks, NULL::VARCHAR AS canonical FROM pages WHERE url IS NOT NULL")
def _(spark, d):
    p = table(spark, d, "pages").where("url is not null")
    return p.select("page_id", is_tracking(F.col("url")).alias("tracks"), canonical_link(F.col("html")).alias("canonical"))


def index(spark, d):
    """Chunks of benchmark items, conversation turns and competitors."""
    b = retrieval.chunks(table(spark, d, "benchmark"), "benchmark", "item_id", "text")
    t = table(spark, d, "conversations").where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("text"))
    c = competitors(spark, d).select("competitor_id", F.concat("name", F.lit(": nation="), "nation", F.lit(" region="), "region").alias("text"))
    return b.unionByName(retrieval.chunks(t, "conversation", "conv_id", "text")).unionByName(retrieval.chunks(c, "competitor", "competitor_id", "text"))


@query("index_chunks", r"""
WITH t AS (SELECT 'benchmark' AS source_type, item_id AS source_id, text FROM benchmark UNION ALL SELECT 'conversation', conv_id, min(text) FROM conversations WHERE turn = 0 GROUP BY 2
UNION ALL SELECT 'competitor', competitor_id, name || ': nation=' || nation || ' region=' || region FROM competitors), x AS (SELECT source_type, source_id, COALESCE(text, '') AS text FROM t)
SELECT source_type || ':' || source_id || ':' || substr(md5(substr(text, 1, 200)), 1, 8) AS chunk_id, length(substr(text, 1, 2000)) AS n_chars,
len(list_distinct(list_filter(regexp_split_to_array(trim(lower(text)), '\s+'), lambda w: length(w) > 2))) AS n_words FROM x""", "competitors")
def _(spark, d):
    return index(spark, d).select("chunk_id", F.length("content").cast("long").alias("n_chars"), F.size("words").cast("long").alias("n_words"))


@query("hash_embedding")
def _(spark, d):
    e = table(spark, d, "documents").select("doc_id", retrieval.hash_embedding(F.coalesce("text", F.lit(""))).alias("e"))
    return e.select("doc_id", F.round(F.element_at("e", 1), 6).alias("first"), F.round(F.element_at("e", 16), 6).alias("last"), F.round(retrieval.dot(F.col("e"), F.col("e")), 6).alias("norm"), F.size("e").alias("dims"))


@query("hybrid_search")
def _(spark, d):
    return retrieval.hybrid_search(index(spark, d), "which nation and region the supplier of the item").withColumn("score", F.round("score", 6))


@query(
    "evidence_pack",
    """WITH p AS (SELECT 'price' AS kind, order_id AS id, service_name || ' at ' || printf('%.2f', price) AS text FROM pricing WHERE competitor_id = 1 QUALIFY row_number() OVER (ORDER BY day DESC, order_id, line) <= 5),
c AS (SELECT 'change', event_id, kind || ' ' || printf('%.1f', value) FROM changes WHERE competitor_id = 1 QUALIFY row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) <= 5),
n AS (SELECT 'count', count(*), count(DISTINCT service_id) || ' services priced' FROM pricing WHERE competitor_id = 1) SELECT * FROM p UNION ALL SELECT * FROM c UNION ALL SELECT * FROM n""",
    "pricing",
    "changes",
)
def _(spark, d):
    """What an answer about competitor 1 would cite: newest prices, greatest changes, counts."""
    p = pricing(spark, d).where("competitor_id = 1")
    new = p.orderBy(F.desc("day"), "order_id", "line").limit(5).select(F.lit("price").alias("kind"), F.col("order_id").alias("id"), F.concat("service_name", F.lit(" at "), F.format_string("%.2f", "price")).alias("text"))
    top = change_events(spark, d).where("competitor_id = 1").orderBy(F.desc_nulls_last("value"), "event_id").limit(5)
    top = top.select(F.lit("change").alias("kind"), F.col("event_id").alias("id"), F.concat("kind", F.lit(" "), F.format_string("%.1f", "value")).alias("text"))
    n = p.agg(F.count("*").alias("id"), F.count_distinct("service_id").alias("s")).select(F.lit("count").alias("kind"), "id", F.concat("s", F.lit(" services priced")).alias("text"))
    return new.unionByName(top).unionByName(n)


@query(
    "row_changes",
    """WITH o AS (SELECT competitor_id, kind, value FROM changes QUALIFY row_number() OVER (PARTITION BY competitor_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT COALESCE(c.competitor_id, o.competitor_id) AS competitor_id, CASE WHEN kind IN ('signup', 'purchase') THEN value ELSE balance END AS balance, CASE WHEN c.competitor_id IS NULL THEN 'inserted' WHEN kind IN ('signup', 'purchase') THEN 'updated' ELSE 'kept' END AS change
FROM competitors c FULL JOIN o USING (competitor_id) WHERE COALESCE(kind, '') <> 'error' AND (c.competitor_id IS NOT NULL OR kind IN ('signup', 'purchase'))""",
    "competitors",
    "changes",
)
def _(spark, d):
    """Single-row inserts, updates and deletes: the newest operation of a key holds (error: delete; signup, purchase: put)."""
    ops = R.latest_per_key(change_events(spark, d).select("competitor_id", "ts", "event_id", "kind", "value"), ["competitor_id"], "ts", "event_id").select("competitor_id", "kind", "value")
    put, base = F.col("kind").isin("signup", "purchase"), competitors(spark, d).select("competitor_id", "balance", F.lit(True).alias("had"))
    both = base.join(ops, "competitor_id", "full_outer").where(F.coalesce("kind", F.lit("")) != "error").where(F.col("had") | put)
    change = F.when(F.col("had").isNull(), "inserted").when(put, "updated").otherwise("kept")
    return both.select("competitor_id", F.when(put, F.col("value")).otherwise(F.col("balance")).alias("balance"), change.alias("change"))


@query(
    "queue_retries",
    """WITH m AS (SELECT competitor_id, kind, row_number() OVER (PARTITION BY competitor_id ORDER BY ts, event_id) AS attempt FROM changes)
SELECT competitor_id, COALESCE(min(attempt) FILTER (kind <> 'error'), least(3, max(attempt))) AS attempts, CASE WHEN min(attempt) FILTER (kind <> 'error') IS NOT NULL THEN 'acked' WHEN max(attempt) >= 3 THEN 'dead' ELSE 'waiting' END AS state FROM m WHERE attempt <= 3 GROUP BY 1""",
    "changes",
)
def _(spark, d):
    """Deliveries of a message (a competitor's): an error is a nack; three of them send it to the dead letters."""
    m = R.top_n_per_key(change_events(spark, d).select("competitor_id", "kind", "ts", "event_id"), ["competitor_id"], [F.col("ts"), F.col("event_id")], 3)
    g = m.groupBy("competitor_id").agg(F.min(F.when(F.col("kind") != "error", F.col("rank"))).alias("ok"), F.max("rank").alias("most"))
    state = F.when(F.col("ok").isNotNull(), "acked").when(F.col("most") >= 3, "dead").otherwise("waiting")
    return g.select("competitor_id", F.coalesce("ok", F.least(F.lit(3), F.col("most"))).cast("long").alias("attempts"), state.alias("state"))


@query(
    "visual_change",
    """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, ('0x' || substr(md5(html), 1, 15))::BIGINT AS h FROM pages WHERE html IS NOT NULL),
x AS (SELECT page_id, bit_count(xor(h, lag(h) OVER (PARTITION BY host ORDER BY page_id)))::INT AS distance FROM h) SELECT page_id, distance, distance > 5 AS changed FROM x WHERE distance IS NOT NULL""",
)
def _(spark, d):
    """Hashes of a host's pages, each against the one before: more than five bits apart is a change."""
    p = table(spark, d, "pages").where("html is not null")
    h = p.select("page_id", F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).alias("host"), F.conv(F.substring(F.md5("html"), 1, 15), 16, 10).cast("long").alias("h"))
    before = F.lag("h").over(Window.partitionBy("host").orderBy("page_id"))
    x = h.withColumn("before", before).where("before is not null")
    return x.select("page_id", F.bit_count(F.col("h").bitwiseXOR(F.col("before"))).cast("int").alias("distance")).withColumn("changed", F.col("distance") > 5)


@query(
    "dormant_entities",
    """WITH r AS (SELECT competitor_id, count(*) AS runs FROM logs GROUP BY 1) SELECT region, count(*) AS all_, count(*) FILTER (runs IS NULL) AS dormant FROM competitors LEFT JOIN r USING (competitor_id) GROUP BY 1""",
    "competitors",
    "logs",
)
def _(spark, d):
    from marketspark.sources.tables import collection_logs

    r = collection_logs(spark, d).groupBy("competitor_id").agg(F.count("*").alias("runs"))
    return competitors(spark, d).join(r, "competitor_id", "left").groupBy("region").agg(F.count("*").alias("all_"), F.count_if(F.col("runs").isNull()).alias("dormant"))
