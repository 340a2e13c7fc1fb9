"""Blocks and segments of the captured pages. Their SQL reads the sections that every captured page has (nav, a div, article,
footer, some cut off) by patterns and scores them by the same fixed words."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.functions.vocabulary import FAQ_START, PRICE_TEXT, SEGMENT_TYPES, SEGMENT_WORDS
from marketspark.functions.page_types import ADDRESSES, HEADINGS, TITLE_SHARE
from marketspark.operators import blocks, classification, dom, pictures
from marketspark.operators.graph import cut
from marketspark.plans.registry import query
from marketspark.sources.tables import table

K = "page_id"


def page_tree(spark, d):
    """The pages' nodes, parsed once and dealt by page, so that no later step parses or shuffles them again."""
    return cut(dom.tree(table(spark, d, "pages"), K))


def _words(column: str, kind: str) -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in SEGMENT_WORDS.get(kind, []))
    more = {"pricing": PRICE_TEXT, "faq": FAQ_START}.get(kind)
    extra = f" + CASE WHEN regexp_matches({column}, '{more}') THEN {0.15 if kind == 'pricing' else 0.10} ELSE 0 END" if more else ""
    return f"least(0.6::DOUBLE, 0.12::DOUBLE * len(list_filter([{words}]::VARCHAR[], lambda w: contains({column}, w))){extra})"


def _scored(units: str) -> str:
    """SQL for typed units; units has page_id, unit, place, is_last, tag, heading, text, links."""
    each = []
    for i, kind in enumerate(SEGMENT_TYPES):
        more = {"hero": " + CASE WHEN place = 0 THEN 0.2::DOUBLE ELSE 0 END", "navigation": " + CASE WHEN links > 0 THEN 0.15::DOUBLE ELSE 0 END", "footer": " + CASE WHEN is_last THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN contains(low, '©') OR contains(low, 'copyright') THEN 0.3::DOUBLE ELSE 0 END"}.get(kind, "")
        tag = {"navigation": "nav", "footer": "footer", "hero": "header"}.get(kind, "-")
        each.append(f"{{'s': round(CASE WHEN tag = '{tag}' THEN 0.5::DOUBLE ELSE 0 END + least(0.35::DOUBLE, 1.4::DOUBLE * {_words('head', kind)}) + {_words('low', kind)} * share * 0.25 / 0.6{more}, 9), 'o': {-i}, 't': '{kind}'}}")
    return f"""scored AS (SELECT *, list_max([{", ".join(each)}]) AS best FROM (SELECT *, lower(text) AS low, lower(heading) AS head,
      CASE WHEN length(text) < 800 THEN 1.0::DOUBLE ELSE greatest(0.3::DOUBLE, 800::DOUBLE / length(text)) END AS share FROM {units})),
    typed AS (SELECT page_id, unit, tag, heading, text, CASE WHEN best.s < 0.08 THEN 'unknown' ELSE best.t END AS type,
      CASE WHEN best.s < 0.08 THEN 0.1::DOUBLE ELSE least(0.95::DOUBLE, greatest(0.1::DOUBLE, best.s)) END AS confidence FROM scored)"""


def _plain(x: str) -> str:
    """SQL for the text of a piece of html: tags are spaces, entities letters, spaces collapsed."""
    for a, b in (("<!--.*?-->", " "), ("<[^>]*(>|$)", " ")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'gs')"
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


#: The four sections of a page, with heading and links.
_PARTS = f"""parts AS (SELECT page_id, unit, tag, h, {_plain("h")} AS text, {_plain("CASE WHEN tag = 'article' THEN regexp_extract(h, '<h1>(.*?)(</h1>|$)', 1, 's') ELSE '' END")} AS heading,
  CASE WHEN tag = 'nav' THEN 1 ELSE 0 END AS links FROM (SELECT page_id, unnest([{{'unit': 1, 'tag': 'nav', 'h': regexp_extract(html, '<nav>(.*?)(</nav>|$)', 1, 's')}},
  {{'unit': 2, 'tag': 'div', 'h': regexp_extract(html, '<div class="ad">(.*?)(</div>|$)', 1, 's')}}, {{'unit': 3, 'tag': 'article', 'h': regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's')}},
  {{'unit': 4, 'tag': 'footer', 'h': regexp_extract(html, '<footer>(.*?)(</footer>|$)', 1, 's')}}], recursive := true) FROM pages WHERE html IS NOT NULL)
  WHERE h <> '')"""


@query(
    "typed_blocks",
    f"""WITH {_PARTS}, units AS (SELECT page_id, unit, 'div' AS tag, heading, text, links, row_number() OVER w - 1 AS place, lead(unit) OVER w IS NULL AS is_last FROM parts WHERE text <> '' WINDOW w AS (PARTITION BY page_id ORDER BY unit)),
    {_scored("units")},
    marked AS (SELECT *, coalesce(lag(type) OVER w <> type, true)::INT AS new FROM typed WINDOW w AS (PARTITION BY page_id ORDER BY unit)),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY unit) AS run FROM marked)
    SELECT page_id, run::BIGINT AS place, min(type) AS type, round(max(confidence), 6) AS confidence, arg_min(heading, unit) AS heading, string_agg(text, ' ' ORDER BY unit) AS text, count(*) AS parts
    FROM runs GROUP BY page_id, run""",
)
def _(spark, d):
    from pyspark.sql import Window

    b = blocks.blocks(page_tree(spark, d), K)
    place = F.row_number().over(Window.partitionBy(K).orderBy("block")).cast("bigint")
    return b.select(K, place.alias("place"), "type", F.round("confidence", 6).alias("confidence"), "heading", "text", "parts")


@query(
    "typed_segments",
    f"""WITH {_PARTS}, units AS (SELECT page_id, unit, tag, heading, text, links, row_number() OVER w - 1 AS place, lead(unit) OVER w IS NULL AS is_last FROM parts WHERE tag IN ('nav', 'footer') OR length(replace(text, ' ', '')) >= 20 OR length(text) >= 20 WINDOW w AS (PARTITION BY page_id ORDER BY unit)),
    {_scored("units")}
    SELECT page_id, tag, type, round(confidence, 6) AS confidence, heading, text FROM typed""",
)
def _(spark, d):
    s = blocks.page_segments(page_tree(spark, d), K)
    return s.select(K, "tag", "type", F.round("confidence", 6).alias("confidence"), "heading", "text")


@query(
    "block_coverage",
    f"""WITH {_PARTS} SELECT page_id, sum(len(list_filter(regexp_split_to_array(regexp_replace(h, '<!--.*?-->', '', 'gs'), '<[^>]*(>|$)'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '')))::BIGINT AS texts, count(*) FILTER (text <> '') AS blocks, true AS whole
    FROM parts GROUP BY page_id""",
)
def _(spark, d):
    """Texts of each page's body, the blocks that hold them, and whether each text is in exactly one."""
    t = page_tree(spark, d)
    held = blocks.members(t, K).where("tag = '#text'").groupBy(K, "node").agg(F.count_distinct("block").alias("n"), F.min("block").alias("block"))
    texts = t.where(F.array_contains("above", "body") & (F.col("tag") == "#text")).select(K, "node")
    n = F.coalesce("n", F.lit(0))
    return texts.join(held, [K, "node"], "left").groupBy(K).agg(F.count("*").alias("texts"), F.count_distinct("block").alias("blocks"), F.bool_and(n == 1).alias("whole"))


def _struct(scores: dict[str, str]) -> str:
    """SQL for the best type of a signal: struct of score, order and type, null for none above 0."""
    from marketspark.functions.page_types import PAGE_TYPES

    each = ", ".join(f"{{'s': ({x})::DOUBLE, 'o': {-PAGE_TYPES.index(t)}, 't': '{t}'}}" for t, x in scores.items())
    return f"list_max(list_filter([{each}], lambda x: x.s > 0))"


def _first(column: str, patterns: dict[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN {w}" for p, w in patterns.items()) + " ELSE 0 END"


def _most(column: str, patterns: dict[str, float]) -> str:
    return "greatest(0, " + ", ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN {w} ELSE 0 END" for p, w in patterns.items()) + ")"


_TOLD = {t: {p.replace("\\", ""): w for p, w in ps.items() if not p.startswith("^")} for t, ps in ADDRESSES.items()}


@query(
    "page_types",
    f"""WITH x AS (SELECT page_id, lower(url) AS u, lower({_plain("regexp_extract(html, '<h1>(.*?)(</h1>|$)', 1, 's')")}) AS h, lower({_plain("regexp_extract(html, '<title>(.*?)(</title>|$)', 1, 's')")}) AS t FROM pages),
    v AS (SELECT page_id, list_filter([{_struct({t: _first("u", p) for t, p in ADDRESSES.items()})}, {_struct({t: _most("h", p) for t, p in HEADINGS.items()})}, {_struct({t: f"round({TITLE_SHARE} * {_most('t', p)}, 9)" for t, p in _TOLD.items()})}], lambda b: b IS NOT NULL) AS b FROM x),
    e AS (SELECT page_id, len(b) AS n, unnest(b) AS w FROM v), g AS (SELECT page_id, any_value(n) AS n, w.t AS t, any_value(w.o) AS o, sum(w.s) AS s FROM e GROUP BY page_id, w.t),
    top AS (SELECT page_id, arg_max(t, (s, o)) AS type, max(s) AS s, any_value(n) AS n FROM g GROUP BY page_id)
    SELECT page_id, coalesce(type, 'unknown') AS type, round(CASE WHEN s IS NULL THEN 0.1 ELSE least(0.95, s / n) END::DOUBLE, 6) AS confidence, coalesce(n, 0)::INTEGER AS signals FROM pages LEFT JOIN top USING (page_id)""",
)
def _(spark, d):
    c = classification.page_types(table(spark, d, "pages"), page_tree(spark, d), K)
    return c.select(K, "type", F.round("confidence", 6).alias("confidence"), F.size("signals").alias("signals"))


_CELL = f"(('0x' || substr(md5(w), 1, 6))::BIGINT % {pictures.CELLS})"


@query(
    "picture_change",
    f"""WITH p AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS a, regexp_replace(regexp_replace(html, '<p>', '<p>Breaking '), '<[^>]*>', ' ', 'g') AS b FROM pages WHERE html IS NOT NULL),
    w AS (SELECT page_id, 'a' AS side, unnest(string_split_regex(a, '\\s+')) AS w FROM p UNION ALL SELECT page_id, 'b', unnest(string_split_regex(b, '\\s+')) FROM p),
    c AS (SELECT page_id, side, {_CELL} AS c, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL), m AS (SELECT page_id, side, map(list(c), list(n)) AS m FROM c GROUP BY ALL),
    h AS (SELECT page_id, side, list_transform(range(0, {pictures.ROWS * pictures.COLUMNS}), lambda k: coalesce(m[(k // {pictures.COLUMNS} * {pictures.COLUMNS + 1} + k % {pictures.COLUMNS})::BIGINT], 0) < coalesce(m[(k // {pictures.COLUMNS} * {pictures.COLUMNS + 1} + k % {pictures.COLUMNS} + 1)::BIGINT], 0)) AS bits FROM m),
    o AS (SELECT a.page_id, a.bits AS a, b.bits AS b, lag(a.bits) OVER (PARTITION BY a.page_id % 16 ORDER BY a.page_id) AS before FROM (SELECT * FROM h WHERE side = 'a') a JOIN (SELECT * FROM h WHERE side = 'b') b USING (page_id))
    SELECT page_id, len(list_filter(list_zip(a, b), lambda z: z[1] <> z[2]))::INTEGER AS edited, CASE WHEN before IS NOT NULL THEN len(list_filter(list_zip(a, before), lambda z: z[1] <> z[2]))::INTEGER END AS other,
      len(list_filter(list_zip(a, b), lambda z: z[1] <> z[2])) > {pictures.SAME} AS changed FROM o""",
)
def _(spark, d):
    """Distances of each page's picture from that of the page with a word more, and from that of another page."""
    from pyspark.sql import Window

    p = table(spark, d, "pages").where("html is not null")
    plain = lambda h: F.regexp_replace(h, "<[^>]*>", " ")
    both = p.select(K, F.explode(F.create_map(F.lit("a"), plain(F.col("html")), F.lit("b"), plain(F.regexp_replace("html", "^((?s).*?)<p>", "$1<p>Breaking ")))).alias("side", "text"))
    h = pictures.drawn(both, [K, "side"], "text").select(K, "side", pictures.difference_hash(F.col("grid")).alias("h"))
    wide = h.groupBy(K).agg(F.max(F.when(F.col("side") == "a", F.col("h"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("h"))).alias("b"))
    before = F.lag("a").over(Window.partitionBy(F.col(K) % 16).orderBy(K))
    edited = pictures.distance(F.col("a"), F.col("b"))
    return wide.withColumn("before", before).select(K, edited.alias("edited"), pictures.distance(F.col("a"), F.col("before")).alias("other"), (edited > pictures.SAME).alias("changed"))
