"""Names, prices, urls, hashes, retrieval and captured pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.functions.price import currency, price
from marketspark.functions.text import REMOVABLE, SHORT, STOP, content_hash, entity_key, normalize, similarity, sorted_key, tokens
from marketspark.functions.urls import TRACKING, normalize_url
from marketspark.operators import documents as D
from marketspark.operators import retrieval
from marketspark.plans.registry import query
from marketspark.sources.tables import change_events, table


@query("normalize_names", r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, levenshtein(p_name, p_brand)::INTEGER AS distance FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", normalize("p_name").alias("name"), F.levenshtein("p_name", "p_brand").alias("distance"))


@query("name_similarity", r"""
WITH t AS (SELECT min(p_partkey) k, count(*) n, list_sort(list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '))) w FROM part GROUP BY w), x AS (SELECT a.k AS a, b.k AS b, a.n AS n_a, b.n AS n_b, len(list_intersect(a.w, b.w)) i, len(list_distinct(list_concat(a.w, b.w))) u, least(len(a.w), len(b.w)) l, len(a.w) <> len(b.w) d FROM t a JOIN t b ON a.k < b.k)
SELECT a, b, n_a, n_b, round(CASE WHEN i / l::DOUBLE >= 0.8 AND d THEN greatest(i / u::DOUBLE, 0.9 * i / l::DOUBLE) ELSE i / u::DOUBLE END, 6) AS similarity FROM x WHERE i > 0""")
def _(spark, d):
    # Parts of the same words are one name: its first part stands for them, with their number.
    t = table(spark, d, "part").groupBy(F.array_sort(tokens("p_name")).alias("w")).agg(F.min("p_partkey").alias("k"), F.count("*").alias("n"))
    word = t.select("k", "n", "w", F.explode("w").alias("x"))
    a, b = (word.select("x", F.col("k").alias(c), F.col("n").alias(f"n_{c}"), F.col("w").alias(f"w{c}")) for c in "ab")
    return a.join(b, "x").where("a < b").dropDuplicates(["a", "b"]).select("a", "b", "n_a", "n_b", F.round(similarity(F.col("wa"), F.col("wb")), 6).alias("similarity"))


@query("catalog_audit", r"""
WITH k AS (SELECT array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '))), ' ') AS key, p_partkey, p_retailprice FROM part)
SELECT key, count(*) AS n, min(p_partkey) AS canonical, max(p_retailprice) - min(p_retailprice) AS spread, CASE WHEN max(p_retailprice) <> min(p_retailprice) THEN 'price_conflict' WHEN count(*) > 1 THEN 'duplicate' ELSE 'unique' END AS finding FROM k GROUP BY 1""")
def _(spark, d):
    k = table(spark, d, "part").withColumn("key", sorted_key("p_name"))
    lo, hi = F.min("p_retailprice"), F.max("p_retailprice")
    return k.groupBy("key").agg(F.count("*").alias("n"), F.min("p_partkey").alias("canonical"), (hi - lo).alias("spread"), F.when(hi != lo, "price_conflict").when(F.count("*") > 1, "duplicate").otherwise("unique").alias("finding"))


@query("parse_price", """SELECT p_partkey, CASE p_partkey % 7 WHEN 5 THEN NULL WHEN 6 THEN CASE WHEN floor(p_retailprice) < 30000 THEN floor(p_retailprice) END ELSE round(p_retailprice, 2) END AS price,
(['INR', 'USD', 'INR', 'EUR', 'GBP', 'INR', 'INR'])[p_partkey % 7 + 1] AS currency FROM part""")
def _(spark, d):
    """Prices as pages write them, made of the parts' prices: a mark before or after, thousands in groups, ranges, a phone number,
    a bare number."""
    p, money = F.col("p_retailprice"), F.format_string("%,.2f", F.round("p_retailprice", 2))
    forms = [F.concat(F.lit("Rs. "), money, F.lit("/- only")), F.concat(F.lit("from $"), money, F.lit(" a visit")), F.concat(F.lit("₹ "), money, F.lit(" - ₹ 999999")), F.concat(money, F.lit(" euro")), F.concat(F.lit("£"), money), F.lit("call 9876543210"), F.floor(p).cast("string")]
    t = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*forms), (F.col("p_partkey") % 7 + 1).cast("int")).alias("text"))
    return t.select("p_partkey", price(F.col("text")).alias("price"), currency(F.col("text")).alias("currency"))


@query("content_hash_dedup", r"""
WITH h AS (SELECT doc_id, sha256(concat_ws('|', coalesce(trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')), 'null'), coalesce(lang, 'null'))) AS hash FROM documents) SELECT hash, min(doc_id) AS first_id, count(*) AS copies FROM h GROUP BY 1""")
def _(spark, d):
    h = table(spark, d, "documents").select("doc_id", content_hash(("text", "string"), ("lang", "string")).alias("hash"))
    return h.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("md5_id", "SELECT doc_id, substr(md5(substr(text, 1, 200)), 1, 8) AS chunk_id FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.md5(F.substring("text", 1, 200)), 1, 8).alias("chunk_id"))


@query("intent", """
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'price|cost') THEN 'pricing' WHEN regexp_matches(lower(text), 'compare|versus') THEN 'comparison' WHEN regexp_matches(lower(text), 'trend|grow') THEN 'trend' WHEN contains(text, '?') THEN 'question' ELSE 'general' END AS intent FROM conversations""")
def _(spark, d):
    t = F.lower("text")
    i = F.when(t.rlike("price|cost"), "pricing").when(t.rlike("compare|versus"), "comparison").when(t.rlike("trend|grow"), "trend").when(F.contains(F.col("text"), F.lit("?")), "question").otherwise("general")
    return table(spark, d, "conversations").select("conv_id", "turn", i.alias("intent"))


@query("cosine_top_k", """
WITH q AS (SELECT vec_id AS query_id, embedding q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)


@query("keyword_search", """
WITH q AS (SELECT unnest(['the', 'and', 'thing', 'idiot']) AS term), t AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS term FROM documents) SELECT doc_id, count(*) AS hits, round(count(*) / 4.0::DOUBLE, 4) AS score FROM t JOIN q USING (term) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def _(spark, d):
    asked = F.array(*[F.lit(x) for x in ("the", "and", "thing", "idiot")])
    hits = F.size(F.array_intersect(F.split(F.lower("text"), " "), asked)).cast("long")
    return table(spark, d, "documents").select("doc_id", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(50).withColumn("score", F.round(F.col("hits") / 4.0, 4))


_URL = r"""u AS (SELECT page_id, lower(regexp_extract(trim(url), '(?i)^(https?)://', 1)) AS scheme, regexp_replace(regexp_replace(trim(url), '(?i)^https?://', ''), '#.*$', '') AS rest FROM pages),
p AS (SELECT page_id, scheme, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), CASE WHEN scheme = 'https' THEN ':443$' ELSE ':80$' END, '') AS host,
regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/{2,}', '/', 'g'), '/$', '') AS path,
array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT list_contains(TRACKING_LIST, lower(string_split(x, '=')[1])))), '&') AS q FROM u),
n AS (SELECT page_id, CASE WHEN scheme <> '' THEN scheme || '://' || host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url FROM p)""".replace("TRACKING_LIST", "[" + ", ".join(f"'{t}'" for t in TRACKING) + "]")


@query("url_canonicalize", f"WITH {_URL} SELECT page_id, url FROM n")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", normalize_url(F.col("url")).alias("url"))


@query("url_dedup", f"WITH {_URL} SELECT url, min(page_id) AS first_id, count(*) AS copies FROM n GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", normalize_url(F.col("url")).alias("url"))
    return p.groupBy("url").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))


_TITLE = "nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')"


@query("page_classify", f"SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(lower(concat_ws(' ', url, {_TITLE})), '{p}') THEN '{n}'" for n, p in D.PAGE_TYPES) + " ELSE 'other' END AS type FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", D.page_type(F.col("url"), D.title(F.col("html"))).alias("type"))


@query("language_detect", r"SELECT page_id, nullif(lower(regexp_extract(html, '<html[^>]*\blang=[\"'']?([a-z]{2})', 1)), '') AS lang FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", D.declared_language(F.col("html")).alias("lang"))


_CLEAN = """trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
'(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"""


@query("html_to_text", f"SELECT page_id, {_TITLE} AS title, {_CLEAN} AS text FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", D.title(F.col("html")).alias("title"), D.clean(F.col("html")).alias("text"))


@query("link_discovery", r"SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(D.links(F.col("html"))).alias("link"))


@query("tech_detect", "SELECT page_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(html), '{p}') THEN '{n}' END" for n, p in sorted(D.TECHNOLOGY.items())) + "], lambda x: x IS NOT NULL), ',') AS technologies FROM pages WHERE html IS NOT NULL")
def _(spark, d):
    return table(spark, d, "pages").where("html is not null").select("page_id", F.array_join(D.technologies(F.col("html")), ",").alias("technologies"))


@query("contact_extract", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x)))), ',') AS emails FROM documents WHERE contains(text, '@')")
def _(spark, d):
    return table(spark, d, "documents").where(F.contains(F.col("text"), F.lit("@"))).select("doc_id", F.array_join(D.emails(F.col("text")), ",").alias("emails"))


@query("dom_blocks")
def _(spark, d):
    return D.blocks(table(spark, d, "pages"))


@query("entity_resolution")
def _(spark, d):
    return D.resolve(table(spark, d, "part").select("p_brand", "p_name"), "p_brand", "p_name")


def _key_sql(c: str) -> str:
    out = rf"trim(regexp_replace(lower({c}), '[^\w]+|_', ' ', 'g'))"
    for k, v in SHORT.items():
        out = rf"regexp_replace({out}, '\b{k}\b', '{v}', 'g')"
    words = "[" + ", ".join(f"'{w}'" for w in (*STOP, *REMOVABLE)) + "]"
    return rf"array_to_string(list_filter(regexp_split_to_array({out}, '\s+'), lambda w: w <> '' AND NOT list_contains({words}, w)), ' ')"


@query("entity_keys", f"SELECT p_partkey, {_key_sql('text')} AS key FROM (SELECT p_partkey, 'The ' || p_name || (['', ' HVAC services', ' & AI plan', ' (SEO)'])[p_partkey % 4 + 1] AS text FROM part)")
def _(spark, d):
    more = F.element_at(F.array(*[F.lit(x) for x in ("", " HVAC services", " & AI plan", " (SEO)")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", entity_key(F.concat(F.lit("The "), "p_name", more)).alias("key"))


@query("window_rate_limit_batch", """
SELECT event_id, competitor_id, count(*) OVER (PARTITION BY competitor_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY competitor_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) > 2 AS limited FROM changes""", "changes")
def _(spark, d):
    from pyspark.sql import Window

    e = change_events(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    n = F.count("*").over(Window.partitionBy("competitor_id").orderBy("us").rangeBetween(-3_600_000_000, 0))
    return e.select("event_id", "competitor_id", n.alias("in_window"), (n > 2).alias("limited"))
