"""Extraction from pages. Each market competitor has a page that is written from the tables (catalog_pages), so what the
strategies read back out of its html is held against SQL over the same tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions.urls import normalize_url, social_handle
from marketspark.operators import dom
from marketspark.operators.dom import attr, classed, nearest
from marketspark.operators.graph import cut
from marketspark.plans.registry import QUERIES, query
from marketspark.sources.tables import change_events, competitors, offered, services, table

K = "competitor_id"
_SERVED = "served AS (SELECT competitor_id, service_id, service_name, category, brand, price FROM services)"
_BRANDS = "brands AS (SELECT competitor_id, brand, count(*) AS n, min(price) AS low FROM services GROUP BY 1, 2)"
_KINDS = "kinds AS (SELECT competitor_id, kind, count(*) AS n, 1 + count(*) % 5 AS rating FROM changes GROUP BY 1, 2)"


def catalog_pages(spark, d) -> DataFrame:
    """competitor_id, html: head with metadata and JSON-LD, breadcrumbs, a price table of all services, brand cards, lists, a
    form, questions, team, reviews in microdata, an address, links to profiles, documents and pictures."""
    line = F.concat(F.lit("<tr><td>"), "p_name", F.lit("<td>$"), F.format_string("%.2f", "p_retailprice"), F.lit("<td>"), "p_type", F.lit("</tr>"))  # once a part
    part = table(spark, d, "part").select(F.col("p_partkey").alias("service_id"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), line.alias("line"))
    c, s = competitors(spark, d), offered(spark, d).join(part, "service_id").repartition(K)  # once for brands and for pages
    card = F.concat(F.lit('<div class="card"><h3>'), "brand", F.lit('</h3><p class="price">$'), F.format_string("%.2f", "low"), F.lit("</p><p>"), "n", F.lit(" services</p></div>"))
    b = s.groupBy(K, "brand").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.collect_list(F.struct("service_id", F.col("line").alias("h"))).alias("lines"))
    rows = F.array_join(F.sort_array(F.flatten(F.collect_list("lines")))["h"], "").alias("rows")
    cards = b.groupBy(K).agg(rows, F.array_join(F.sort_array(F.collect_list(card)), "").alias("cards"), F.sort_array(F.collect_list(F.concat(F.lit("<option>"), "brand", F.lit("</option>")))).alias("options"), F.sum("n").alias("n"))
    seen = change_events(spark, d).groupBy(K, "kind").agg(F.count("*").alias("n"))
    review = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Review"><span itemprop="author">'), "kind", F.lit('</span> <span itemprop="ratingValue">'), F.col("n") % 5 + 1, F.lit("</span></div>"))
    reviews = seen.groupBy(K).agg(F.array_join(F.sort_array(F.collect_list(review)), "").alias("reviews"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<li>"), "kind", F.lit("</li>")))), "").alias("kinds"))
    page = c.join(cards, K, "left").join(reviews, K, "left").na.fill("", ["rows", "cards", "reviews", "kinds"]).na.fill(0, ["n"])
    ld = F.to_json(F.struct(F.lit("Organization").alias("@type"), "name", F.struct(F.col("nation").alias("addressLocality"), F.col("region").alias("addressRegion")).alias("address"), F.col("n").alias("numberOfItems")))
    site = F.concat(F.lit("https://www.s"), K, F.lit(".example.com"))
    parts = [
        F.lit('<html lang="en"><head><title>'), "name", F.lit(' | market</title><meta property="og:site_name" content="'), "name", F.lit('"><meta name="description" content="From '), "nation",
        F.lit('"><link rel="canonical" href="'), site, F.lit('/?utm_source=x"><script type="application/ld+json">'), ld, F.lit("</script></head><body>"),
        F.lit('<nav class="breadcrumb"><a href="/">Home</a><a href="/r">'), "region", F.lit('</a><a href="/n">'), "nation", F.lit("</a></nav><h1>"), "name", F.lit("</h1>"),
        F.lit("<section><h2>Price list</h2><table><tr><th>Service<th>Price<th>Category</tr>"), "rows", F.lit('</table></section><section><h2>Brands</h2><div class="cards">'), "cards",
        F.lit("</div></section><section><h2>What changed</h2><ul>"), "kinds", F.lit('</ul></section><form action="/ask"><label for="b">Brand</label><select id="b" name="brand">'), F.array_join(F.coalesce("options", F.array().cast("array<string>")), ""),
        F.lit('</select><input type="email" name="mail"></form><section><h2>FAQ</h2><dl><dt>How many services?</dt><dd>'), "n", F.lit("</dd><dt>Where?</dt><dd>"), "nation",
        F.lit('</dd></dl></section><section class="team"><h2>Team</h2><div class="member"><h3>Lead of '), "name", F.lit("</h3><p>Director</p></div></section><section><h2>Reviews</h2>"), "reviews",
        F.lit("</section><address>"), "nation", F.lit(", "), "region", F.lit('</address><img src="/logo.png" alt="'), "name", F.lit(' logo" width="120"><img src="/dot.png" width="1"><img class="badge" src="/iso.png" alt="ISO 9001 certified" width="64">'),
        F.lit('<footer><a href="mailto:info@s'), K, F.lit('.example.com">mail</a><a href="tel:+1-555-01'), F.lpad(K, 4, "0"), F.lit('">call</a><a href="https://www.linkedin.com/company/s'), K,
        F.lit('">in</a><a href="https://twitter.com/">share</a><a href="/terms.pdf" download>Terms</a></footer></body></html>'),
    ]
    return page.select(K, F.concat(*[F.col(p) if isinstance(p, str) else p for p in parts]).alias("html"))


def page_nodes(spark, d, *tags: str, attrs: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """The pages' nodes of these tags or with one of these attributes. once: kept, for queries that go through them several
    times, so that pages are written and parsed but once."""
    n = dom.nodes(catalog_pages(spark, d), K, tags=tags, attrs=attrs)
    return cut(n) if once else n


def json_ld_of(n: DataFrame) -> DataFrame:
    kind = "name string, address struct<addressLocality:string, addressRegion:string>, numberOfItems bigint"
    ld = n.where((F.col("tag") == "script") & (attr("type") == "application/ld+json")).withColumn("j", F.from_json("text", kind))
    return ld.select(K, "j.name", F.col("j.address.addressLocality").alias("locality"), F.col("j.address.addressRegion").alias("area"), F.col("j.numberOfItems").alias("items"))


@query("extraction_json_ld", "SELECT competitor_id, name, nation AS locality, region AS area, COALESCE(n, 0) AS items FROM competitors LEFT JOIN (SELECT competitor_id, count(*) n FROM services GROUP BY 1) USING (competitor_id)", "competitors", "services")
def _(spark, d):
    return json_ld_of(page_nodes(spark, d, "script"))


def microdata_of(n: DataFrame) -> DataFrame:
    """Items of itemscope: a row an item, its properties pivoted; the first of a property counts."""
    scopes = n.where(F.coalesce(attr("itemtype"), F.lit("")).endswith("/Review")).select(K, F.col("node").alias("scope"))
    props = dom.within(n.where(attr("itemprop").isNotNull()), scopes, K).withColumn("prop", attr("itemprop"))
    wide = props.groupBy(K, "scope").pivot("prop", ["author", "ratingValue"]).agg(F.min_by("text", "node"))
    return wide.select(K, "author", F.col("ratingValue").cast("long").alias("rating"))


@query("extraction_microdata", f"WITH {_KINDS} SELECT competitor_id, kind AS author, rating FROM kinds JOIN competitors USING (competitor_id)", "competitors", "changes")
def _(spark, d):
    return microdata_of(page_nodes(spark, d, attrs=("itemtype", "itemprop"), once=True))


def services_of(t: DataFrame) -> DataFrame:
    """key, service, category, price of each line of tables (dom.tables) that has a cell under a head; columns are told by their
    heads' words, the first that the line has counts."""
    role = lambda x: F.when(F.lower(x).rlike("price|cost|rate"), "price").when(F.lower(x).rlike("service|name|item"), "service").when(F.lower(x).rlike("category|type"), "category")

    def places(name: str | None):
        """Places with a head, of this role if one is named."""
        ok = lambda x: F.lit(True) if name is None else role(x) == name
        return F.filter(F.sequence(F.lit(0), F.size("heads") - 1), lambda p: F.exists(F.get("heads", p), ok))

    def at_first(name: str):
        return F.get("cells", F.get(f"_{name}", F.lit(0)))

    def said(name: str):
        return F.coalesce(at_first(name), F.try_element_at(F.filter(F.transform(f"_{name}", lambda p: F.get("cells", p)), F.isnotnull), F.lit(1)))

    lines = t.select(K, places(None).alias("_any"), *[places(r).alias(f"_{r}") for r in ("service", "price", "category")], "lines").select("*", F.explode("lines").alias("cells")).drop("lines")
    lines = lines.where(at_first("any").isNotNull() | F.exists("_any", lambda p: F.get("cells", p).isNotNull()))
    return lines.select(K, said("service").alias("service"), said("category").alias("category"), F.regexp_replace(said("price"), "[^0-9.]", "").try_cast("double").alias("price"))


@query("extraction_tables", f"WITH {_SERVED} SELECT competitor_id, service_name AS service, category, round(price, 2) AS price FROM served", "services")
def _(spark, d):
    """Columns are told by their header's words, rows become services."""
    return services_of(dom.tables(catalog_pages(spark, d), K))


def forms_of(n: DataFrame) -> DataFrame:
    labels = n.where("tag = 'label'").select(K, attr("for").alias("id"), F.col("text").alias("label"))
    field = n.where("tag in ('select', 'input', 'textarea')").withColumn("form", nearest("form")).where("form is not null")
    field = field.select(K, "node", attr("id").alias("id"), F.when(F.col("tag") == "input", F.coalesce(attr("type"), F.lit("text"))).otherwise(F.col("tag")).alias("kind"))
    options = n.where("tag = 'option'").withColumn("node", nearest("select")).groupBy(K, "node").agg(F.count("*").alias("options"), F.min("text").alias("first"))
    out = field.join(labels, [K, "id"], "left").join(options, [K, "node"], "left")
    return out.where("kind <> 'select' or options > 0").select(K, "label", "kind", F.coalesce("options", F.lit(0)).alias("options"), "first")


@query("extraction_forms", f"WITH {_BRANDS} SELECT competitor_id, 'Brand' AS label, 'select' AS kind, count(*) AS options, min(brand) AS first FROM brands GROUP BY 1 UNION ALL SELECT competitor_id, NULL, 'email', 0, NULL FROM competitors WHERE competitor_id IN (SELECT competitor_id FROM competitors)", "competitors", "services")
def _(spark, d):
    return forms_of(page_nodes(spark, d, "label", "select", "input", "textarea", "option", once=True))


def faq_of(n: DataFrame) -> DataFrame:
    """Definition lists and details: the answer is what follows the question; repeated questions count once."""
    from pyspark.sql import Window

    n = n.where("tag in ('dt', 'dd', 'summary')")
    after = F.lead(F.when(F.col("tag") == "dd", F.col("text"))).over(Window.partitionBy(K).orderBy("node"))
    qa = n.withColumn("answer", after).where("tag in ('dt', 'summary') and answer is not null")
    return qa.groupBy(K, F.lower("text").alias("q")).agg(F.min_by(F.struct("text", "answer"), "node").alias("x")).select(K, F.col("x.text").alias("question"), "x.answer")


@query("extraction_faq", "SELECT competitor_id, 'How many services?' AS question, COALESCE(n, 0)::VARCHAR AS answer FROM competitors LEFT JOIN (SELECT competitor_id, count(*) n FROM services GROUP BY 1) USING (competitor_id) UNION ALL SELECT competitor_id, 'Where?', nation FROM competitors", "competitors", "services")
def _(spark, d):
    return faq_of(page_nodes(spark, d, "dt", "dd", "summary"))


def breadcrumbs_of(n: DataFrame) -> DataFrame:
    crumbs = n.where((F.col("tag") == "nav") & classed("breadcrumb")).select(K, F.col("node").alias("scope"))
    path = dom.within(n.where("tag = 'a'"), crumbs, K).groupBy(K, "scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]).alias("p"))
    return path.where(F.size("p") >= 3).select(K, F.array_join("p", "/").alias("path"), F.element_at("p", -1).alias("leaf"), F.element_at("p", -2).alias("parent"))


@query("extraction_breadcrumbs", "SELECT competitor_id, 'Home/' || region || '/' || nation AS path, nation AS leaf, region AS parent FROM competitors", "competitors")
def _(spark, d):
    return breadcrumbs_of(page_nodes(spark, d, "nav", "a", once=True))


def cards_of(n: DataFrame) -> DataFrame:
    """Repeated children of one class under one parent, two at least: each is a card with its heading, price and text."""
    card = n.where(classed("card")).select(K, F.col("node").alias("scope"), "parent")
    many = card.groupBy(K, "parent").agg(F.count("*").alias("k")).where("k >= 1").select(K, "parent")
    inner = dom.within(n.where("tag in ('h2', 'h3', 'h4', 'p')"), card.join(many, [K, "parent"]), K)
    price = F.when(classed("price"), F.regexp_replace("text", "[^0-9.]", "").cast("double"))
    count = F.when(F.col("text").rlike("^[0-9]+ services$"), F.regexp_extract("text", "^([0-9]+)", 1).cast("long"))
    return inner.groupBy(K, "scope").agg(F.min_by(F.when(F.col("tag") != "p", F.col("text")), "node").alias("name"), F.max(price).alias("price"), F.max(count).alias("services")).drop("scope")


@query("extraction_cards", f"WITH {_BRANDS} SELECT competitor_id, brand AS name, round(low, 2) AS price, n AS services FROM brands", "services")
def _(spark, d):
    return cards_of(page_nodes(spark, d, "h2", "h3", "h4", "p", attrs=("class",), once=True))


def lists_of(n: DataFrame) -> DataFrame:
    return dom.headed(n, K).where("tag = 'li'").select(K, "heading", F.col("text").alias("item"))


@query("extraction_lists", f"WITH {_KINDS} SELECT competitor_id, 'What changed' AS heading, kind AS item FROM kinds JOIN competitors USING (competitor_id)", "competitors", "changes")
def _(spark, d):
    return lists_of(page_nodes(spark, d, "h1", "h2", "h3", "h4", "h5", "h6", "li"))


def locations_of(n: DataFrame) -> DataFrame:
    """Address tags, checked against what JSON-LD says; both agreeing is worth half."""
    ld = n.where((F.col("tag") == "script") & (attr("type") == "application/ld+json")).select(K, F.get_json_object("text", "$.address.addressLocality").alias("known"))
    a = n.where("tag = 'address'").withColumn("p", F.split("text", r"\s*,\s*")).select(K, F.element_at("p", 1).alias("city"), F.try_element_at("p", F.lit(2)).alias("state"))
    return a.join(ld, K, "left").select(K, "city", "state", F.when(F.col("city") == F.col("known"), 0.5).otherwise(0.25).alias("confidence"))


@query("extraction_locations", "SELECT competitor_id, nation AS city, region AS state, 0.5::DOUBLE AS confidence FROM competitors", "competitors")
def _(spark, d):
    return locations_of(page_nodes(spark, d, "script", "address", once=True))


def team_of(n: DataFrame) -> DataFrame:
    scopes = n.where(classed("member")).select(K, F.col("node").alias("scope"))
    inner = dom.within(n.where("tag in ('h3', 'h4', 'p')"), scopes, K)
    return inner.groupBy(K, "scope").agg(F.min_by(F.when(F.col("tag") != "p", F.col("text")), "node").alias("person"), F.max(F.when(F.col("tag") == "p", F.col("text"))).alias("role")).drop("scope")


@query("extraction_team", "SELECT competitor_id, 'Lead of ' || name AS person, 'Director' AS role FROM competitors", "competitors")
def _(spark, d):
    return team_of(page_nodes(spark, d, "h3", "h4", "p", attrs=("class",), once=True))


@query("extraction_reviews", f"WITH {_KINDS} SELECT competitor_id, count(*) AS reviews, round(avg(rating), 4) AS rating FROM kinds JOIN competitors USING (competitor_id) GROUP BY 1", "competitors", "changes")
def _(spark, d):
    r = page_nodes(spark, d, attrs=("itemprop",)).where(attr("itemprop") == "ratingValue").select(K, F.col("text").try_cast("double").alias("rating"))
    return r.where("rating between 0 and 5").groupBy(K).agg(F.count("*").alias("reviews"), F.round(F.avg("rating"), 4).alias("rating"))


@query("extraction_trust", "SELECT competitor_id, 'ISO 9001' AS signal FROM competitors", "competitors")
def _(spark, d):
    text = F.coalesce(attr("alt"), F.col("text"))
    hit = page_nodes(spark, d, "img", "li", "p", "span").where("tag in ('img', 'li', 'p', 'span')").select(K, F.nullif(F.regexp_extract(text, r"(?i)\b(ISO ?[0-9]{4,5}|SOC ?2|PCI[- ]DSS|GDPR|HIPAA)\b", 1), F.lit("")).alias("signal"))
    return hit.where("signal is not null").distinct()


@query("extraction_assets", "SELECT competitor_id, '/terms.pdf' AS href, 'pdf' AS kind, 'Terms' AS title FROM competitors", "competitors")
def _(spark, d):
    kind = F.nullif(F.lower(F.regexp_extract(attr("href"), r"\.(pdf|docx?|xlsx?|pptx?|zip|csv)(?:[?#]|$)", 1)), F.lit(""))
    a = page_nodes(spark, d, "a").where("tag = 'a'").withColumn("kind", kind).where(F.col("kind").isNotNull() | attr("download").isNotNull())
    return a.select(K, attr("href").alias("href"), "kind", F.col("text").alias("title"))


@query("extraction_media", "SELECT competitor_id, '/logo.png' AS src, 'logo' AS kind FROM competitors UNION ALL SELECT competitor_id, '/iso.png', 'badge' FROM competitors", "competitors")
def _(spark, d):
    """Pictures of 48 pixels at least (or of no stated width), typed by what their name and text say."""
    img = page_nodes(spark, d, "img").where("tag = 'img'").where(F.coalesce(attr("width").try_cast("int"), F.lit(48)) >= 48)
    said = F.lower(F.concat_ws(" ", attr("src"), attr("alt"), attr("class")))
    return img.select(K, attr("src").alias("src"), F.when(said.rlike("logo"), "logo").when(said.rlike("badge|certif"), "badge").otherwise("image").alias("kind"))


@query("extraction_generic", "SELECT competitor_id, name, 'info@s' || competitor_id || '.example.com' AS email, '+1-555-01' || lpad(competitor_id::VARCHAR, 4, '0') AS phone FROM competitors", "competitors")
def _(spark, d):
    href = attr("href")
    n = page_nodes(spark, d, "h1", "a").where("tag in ('h1', 'a')")
    scheme = lambda s: F.min_by(F.when(href.startswith(s), F.regexp_replace(href, f"^{s}", "")), "node")
    first = F.min_by("text", F.when(F.col("tag") == "h1", F.col("node")))
    return n.groupBy(K).agg(first.alias("name"), F.max(F.when(href.startswith("mailto:"), F.substring(href, 8, 200))).alias("email"), F.max(F.when(href.startswith("tel:"), F.substring(href, 5, 60))).alias("phone"))


@query("social_handles", "SELECT competitor_id, 'linkedin.com' AS platform, 's' || competitor_id AS handle FROM competitors", "competitors")
def _(spark, d):
    a = page_nodes(spark, d, "a").where("tag = 'a'").select(K, social_handle(attr("href")).alias("s")).where("s is not null")
    return a.select(K, "s.platform", "s.handle").distinct()


@query("extraction_headed_blocks", f"WITH {_BRANDS} SELECT competitor_id, count(*) + 1 AS blocks FROM brands GROUP BY 1", "services")
def _(spark, d):
    """Blocks with a heading of their own: cards and members (sections hold other blocks)."""
    n = page_nodes(spark, d, "h3", "div", "article", "li", once=True)
    h = n.where("tag = 'h3'").select(K, F.col("parent").alias("node"))
    blocks = n.where("tag in ('div', 'article', 'li')").join(h, [K, "node"], "left_semi")
    return blocks.groupBy(K).agg(F.count("*").alias("blocks")).where("blocks > 1")


@query("extraction_regex", "SELECT competitor_id, 'info@s' || competitor_id || '.example.com' AS email, '+1-555-01' || lpad(competitor_id::VARCHAR, 4, '0') AS phone FROM competitors", "competitors")
def _(spark, d):
    found = lambda pattern: F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
    return catalog_pages(spark, d).select(K, found(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})").alias("email"), found(r"(\+[0-9][0-9 ()-]{6,}[0-9])").alias("phone"))


@query("extraction_metadata", "SELECT competitor_id, name AS site, 'From ' || nation AS description, 'https://s' || competitor_id || '.example.com' AS canonical FROM competitors", "competitors")
def _(spark, d):
    n = page_nodes(spark, d, "meta", "link").where("tag in ('meta', 'link')")
    name = F.coalesce(attr("property"), attr("name"))
    first = lambda found, value: F.min_by(attr(value), F.when(found & attr(value).isNotNull(), F.col("node")))
    own = F.coalesce(first((F.col("tag") == "link") & (attr("rel") == "canonical"), "href"), first(name == "og:url", "content"))
    said = lambda x: F.max(F.when(name == x, attr("content")))
    m = n.groupBy(K).agg(said("og:site_name").alias("site"), said("description").alias("description"), own.alias("own"))
    return m.select(K, "site", "description", normalize_url(F.col("own")).alias("canonical"))


def candidates(spark, d) -> DataFrame:
    """competitor_id, field, strategy, value: what several strategies say of one field."""
    n = page_nodes(spark, d, "h1", "title", attrs=("type", "property", "name", "href"))
    name = F.coalesce(attr("property"), attr("name"))
    said = {
        ("name", "json_ld"): F.when(attr("type") == "application/ld+json", F.get_json_object("text", "$.name")),
        ("name", "generic"): F.when(F.col("tag") == "h1", F.col("text")),
        ("name", "metadata"): F.when(name == "og:site_name", attr("content")),
        ("name", "regex"): F.when(F.col("tag") == "title", F.col("text")),
        ("place", "json_ld"): F.when(attr("type") == "application/ld+json", F.get_json_object("text", "$.address.addressLocality")),
        ("place", "metadata"): F.when(name == "description", attr("content")),
        ("email", "generic"): F.when(attr("href").startswith("mailto:"), F.substring(attr("href"), 8, 200)),
    }
    each = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(f).alias("field"), F.lit(s).alias("strategy"), v.alias("value"))) for (f, s), v in said.items()]))
    return n.select(K, F.explode(each).alias("c")).select(K, "c.*")


@query("field_confidence", "SELECT competitor_id, field, strategy, round(c::DOUBLE, 6) AS confidence FROM competitors, (VALUES ('name', 'json_ld', 0.3 + 0.5 + 0.2 * 2 / 3), ('name', 'generic', 0.1 + 0.5 + 0.2 * 2 / 3), ('name', 'metadata', 0.1 + 0.5 + 0.2 * 2 / 3), ('name', 'regex', 0.05 + 0.5), ('place', 'json_ld', 0.8), ('place', 'metadata', 0.6), ('email', 'generic', 0.6)) t(field, strategy, c)", "competitors")
def _(spark, d):
    return dom.field_confidence(candidates(spark, d)).select(K, "field", "strategy", "confidence")


@query("merge_fields", "SELECT competitor_id, 'name' AS field, name AS value, 'json_ld' AS strategy FROM competitors UNION ALL SELECT competitor_id, 'place', nation, 'json_ld' FROM competitors UNION ALL SELECT competitor_id, 'email', 'info@s' || competitor_id || '.example.com', 'generic' FROM competitors", "competitors")
def _(spark, d):
    return dom.merge_fields(dom.field_confidence(candidates(spark, d))).select(K, "field", "value", "strategy")


@query("projections", "SELECT competitor_id, name, nation AS place, 'info@s' || competitor_id || '.example.com' AS email FROM competitors", "competitors")
def _(spark, d):
    """Merged fields as a company's row."""
    m = dom.merge_fields(dom.field_confidence(candidates(spark, d)))
    return m.groupBy(K).pivot("field", ["name", "place", "email"]).agg(F.first("value"))


@query("page_segments", "SELECT competitor_id, segment, n FROM competitors, (VALUES ('nav', 1), ('pricing', 2), ('faq', 2), ('team', 1), ('reviews', 1), ('locations', 1), ('contact', 1), ('footer', 1)) t(segment, n)", "competitors")
def _(spark, d):
    s = dom.segments(page_nodes(spark, d, *dom.BLOCKS, "h1", "h2", "h3", "h4", "h5", "h6", once=True), K)
    return s.where("segment <> 'unknown'").groupBy(K, "segment").agg(F.count("*").cast("int").alias("n"))


@query("best_segment", "SELECT competitor_id, 'table' AS tag, 0.85::DOUBLE AS score FROM competitors", "competitors")
def _(spark, d):
    """Each page's best pricing segment."""
    s = dom.segments(page_nodes(spark, d, *dom.BLOCKS, "h1", "h2", "h3", "h4", "h5", "h6", once=True), K).where("segment = 'pricing'")
    return s.groupBy(K).agg(F.max_by(F.struct("tag", "score"), F.struct("score", -F.col("node"))).alias("b")).select(K, "b.tag", "b.score")


@query("evidence_paths", "SELECT competitor_id, 'html > body > h1' AS path, name AS snippet FROM competitors", "competitors")
def _(spark, d):
    return page_nodes(spark, d, "h1").where("tag = 'h1'").select(K, dom.css_path().alias("path"), F.substring("text", 1, 200).alias("snippet"))


@query("relationship_links", f"WITH {_BRANDS} SELECT competitor_id, brand AS card, brand AS option, 1.0::DOUBLE AS confidence FROM brands", "services")
def _(spark, d):
    """Cards and form options of one page that name the same thing: 1 where equal, else the share that the shorter name is of the
    longer where it is part of it and 0.6 of it at least; the best option a card."""
    n = page_nodes(spark, d, "h3", "option", attrs=("class",), once=True)
    card = n.where("tag = 'h3'").withColumn("c", nearest("div")).join(n.where(classed("card")).select(K, F.col("node").alias("c")), [K, "c"]).select(K, F.col("text").alias("card"))
    option = n.where("tag = 'option'").select(K, F.col("text").alias("option"))
    exact = card.join(option, (card[K] == option[K]) & (card.card == option.option)).select(card[K], "card", "option", F.lit(1.0).alias("confidence"))
    share = F.least(F.length("card"), F.length("option")) / F.greatest(F.length("card"), F.length("option"))
    rest = card.join(exact.select(K, "card"), [K, "card"], "left_anti")
    part = rest.join(option, K).where(F.contains("card", "option") | F.contains("option", "card")).withColumn("confidence", F.round(share, 4)).where("confidence >= 0.6")
    best = part.groupBy(K, "card").agg(F.max_by(F.struct("option", "confidence"), F.struct("confidence", "option")).alias("b")).select(K, "card", "b.option", "b.confidence")
    return exact.unionByName(best)


@query("proximity_relations", f"WITH {_BRANDS} SELECT competitor_id, brand AS name, '$' || printf('%.2f', low) AS price, 'card' AS container FROM brands", "services")
def _(spark, d):
    """A heading and a price that share their nearest container are related."""
    n = page_nodes(spark, d, "h3", attrs=("class",), once=True).withColumn("box", nearest("div")).where("box is not null")
    h = n.where("tag = 'h3'").select(K, "box", F.col("text").alias("name"))
    p = n.where(classed("price")).select(K, "box", F.col("text").alias("price"))
    return h.join(p, [K, "box"]).select(K, "name", "price", F.lit("card").alias("container"))


@query("catalog_mapping", "SELECT service_id, CASE WHEN regexp_matches(service_name, '\\b(ring|bolt)\\b') THEN 'fasteners' WHEN regexp_matches(service_name, '\\b(gear|widget)\\b') THEN 'parts' ELSE 'other' END AS entry, count(*) AS offers FROM services GROUP BY 1, 2", "services")
def _(spark, d):
    """Services to catalog entries by whole words, the first entry that fits."""
    name = F.col("service_name")
    entry = F.when(name.rlike(r"\b(ring|bolt)\b"), "fasteners").when(name.rlike(r"\b(gear|widget)\b"), "parts").otherwise("other")
    return services(spark, d).groupBy("service_id", entry.alias("entry")).agg(F.count("*").alias("offers"))


#: Strategies that go through the same nodes; tables, which take most of them, go through their own.
STRATEGIES = {"extraction_json_ld": json_ld_of, "extraction_microdata": microdata_of, "extraction_forms": forms_of, "extraction_faq": faq_of, "extraction_breadcrumbs": breadcrumbs_of, "extraction_cards": cards_of, "extraction_lists": lists_of, "extraction_locations": locations_of, "extraction_team": team_of}
_TAGS = "script address label select input textarea option dt dd summary nav a h1 h2 h3 h4 h5 h6 p li".split()


@query(
    "extraction_contributions",
    f"""WITH {_BRANDS}, {_KINDS}, k AS (SELECT * FROM kinds WHERE competitor_id IN (SELECT competitor_id FROM competitors)), n AS (SELECT count(*) AS c FROM competitors)
SELECT 'extraction_json_ld' AS strategy, c AS rows_ FROM n UNION ALL SELECT 'extraction_microdata', count(*) FROM k UNION ALL SELECT 'extraction_tables', count(*) FROM services
UNION ALL SELECT 'extraction_forms', c + (SELECT count(DISTINCT competitor_id) FROM brands) FROM n UNION ALL SELECT 'extraction_faq', 2 * c FROM n UNION ALL SELECT 'extraction_breadcrumbs', c FROM n
UNION ALL SELECT 'extraction_cards', count(*) FROM brands UNION ALL SELECT 'extraction_lists', count(*) FROM k UNION ALL SELECT 'extraction_locations', c FROM n UNION ALL SELECT 'extraction_team', c FROM n""",
    "competitors",
    "services",
    "changes",
)
def _(spark, d):
    """All strategies run and counted, over nodes that are parsed once."""
    n = page_nodes(spark, d, *_TAGS, attrs=("itemtype", "itemprop", "class"), once=True)
    found = {"extraction_tables": QUERIES["extraction_tables"](spark, d), **{s: f(n) for s, f in STRATEGIES.items()}}
    return reduce(DataFrame.unionByName, [f.agg(F.count("*").alias("rows_")).select(F.lit(s).alias("strategy"), "rows_") for s, f in found.items()])
