"""Blocks, segments and structured data of pages: fixtures of varied, nested and broken markup, and a plain recursive splitter."""

import random

import pytest

from marketspark.operators import blocks, dom, structured

PAGE = """<html><head><title>x</title></head><body><header>Welcome to Us</header><div><h2>Our services</h2><p>We do things</p>
<h2>Pricing plans</h2><div class="g"><div><h3>Basic plan</h3><p>$10 per month</p></div><div><h3>Pro plan</h3><p>$20 per month</p></div>
<div><h3>Max plan</h3><p>$30 per month</p></div></div></div>loose text <b>bold</b><main><section><h2>FAQ</h2><details><summary>How do I pay?
</summary>By card</details><details><summary>What is it?</summary>ok</details></section><form>Contact us <input></form></main>
<footer>&copy; 2024</footer></body></html>"""


def tree(spark, *htmls):
    return dom.tree(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string"), "page_id").cache()


def test_blocks_of_a_page(spark):
    got = [(r.type, round(r.confidence, 4), r.heading, r.parts) for r in blocks.blocks(tree(spark, PAGE), "page_id").orderBy("block").collect()]
    assert got == [
        ("hero", 0.25, "", 1), ("services", 0.218, "Our services", 1), ("pricing", 0.5485, "Pricing plans", 1), ("unknown", 0.1, "", 1),
        ("faq", 0.3417, "FAQ", 3), ("contact", 0.25, "", 1), ("footer", 0.6, "", 1),
    ]


def test_segments_of_a_page(spark):
    got = [(r.tag, r.type, round(r.confidence, 4)) for r in blocks.page_segments(tree(spark, PAGE), "page_id").orderBy("node").collect()]
    assert got == [("header", "hero", 0.75), ("div", "services", 0.218), ("main", "faq", 0.568), ("footer", "footer", 0.95)]


@pytest.mark.parametrize(
    ("html", "tag", "kind", "least"),
    [
        ('<nav role="navigation"><a href="/">Home</a><a href="/b">About</a></nav>', "nav", "navigation", 0.5),
        ('<section itemscope itemtype="https://schema.org/FAQPage"><h2>Frequently asked questions</h2><p>How do I start?</p></section>', "section", "faq", 0.7),
        ("<section><h2>Pricing</h2><table><tr><th>Plan</th><th>Price</th></tr><tr><td>Basic</td><td>$10</td></tr></table></section>", "section", "pricing", 0.6),
        ('<div aria-label="contact form"><form><p>Write to us, we answer all</p></form></div>', "div", "contact", 0.4),
        ("<section><h2>What our customers say</h2><blockquote>Five star rating, recommended</blockquote></section>", "section", "reviews", 0.25),
        ('<div role="contentinfo">© 2020 Some Company, all rights reserved</div>', "div", "footer", 0.8),
        ("<section><p>Lorem ipsum dolor sit amet consectetur</p></section>", "section", "unknown", 0.1),
    ],
)
def test_segment_types(spark, html, tag, kind, least):
    """Between two neutral segments, so that place says nothing."""
    neutral = "<div>zzzz zzzz zzzz zzzz zzzz zzzz</div>"
    got = blocks.page_segments(tree(spark, f"<body>{neutral}{html}{neutral}</body>"), "page_id").orderBy("node").collect()[1]
    assert (got.tag, got.type) == (tag, kind) and got.confidence >= least


def test_segments_inside_segments(spark):
    html = "<body><div><section>inner section with enough text</section><nav>n</nav></div><main><div>first of main, long enough</div></main><p>x</p></body>"
    got = [r.tag for r in blocks.page_segments(tree(spark, html), "page_id").orderBy("node").collect()]
    assert got == ["div", "nav", "main"]


class Plain:
    """The splitting rules, walked top down."""

    def __init__(self, rows):
        self.tag = {r.node: r.tag for r in rows}
        self.kids, self.text = {}, {}
        for r in sorted(rows, key=lambda r: r.node):
            self.kids.setdefault(r.parent, []).append(r.node)
            self.text[r.node] = r.text
        self.out = []

    def below(self, n):
        return [n, *[x for k in self.kids.get(n, []) for x in self.below(k)]]

    def texts(self, group):
        return [x for n in group for x in self.below(n) if self.tag[x] == "#text"]

    def loose(self, n):
        return self.tag[n] == "#text" or self.tag[n] in blocks.PHRASES

    def emit(self, group):
        if self.texts(group):
            self.out.append(sorted(self.texts(group)))

    def split(self, n, base):
        kids = self.kids.get(n, [])
        heads = [k for k in kids if self.tag[k] in ("h1", "h2", "h3")]
        if base not in blocks.BOUNDARIES and len(heads) >= 2:
            group = []
            for k in kids:
                if k in heads and group:
                    self.part(group, n, "div")
                    group = []
                group.append(k)
            self.part(group, n, "div")
        else:
            self.part(kids, n, base)

    def atomic(self, n):
        kids = self.kids.get(n, [])
        heads = [k for k in kids if self.tag[k] in ("h1", "h2", "h3")]
        if self.tag[n] not in blocks.BOUNDARIES and len(heads) >= 2:
            return False
        return self.mode(kids, self.tag[n]) == "atomic"

    def mode(self, kids, base):
        own = [k for k in kids if not self.loose(k)]
        if base in blocks.BOUNDARIES:
            return "children" if own else "atomic"
        spoken = sum(any(self.tag[x] in (*blocks.HEADINGS, "p") for x in self.below(k)[1:]) for k in own)
        alike = len({self.tag[k] for k in own}) == 1 or all(self.tag[k] in blocks.ALIKE for k in own)
        if len(own) >= 3 and alike and all(sum(len(self.text[x]) for x in self.texts([k])) >= 10 for k in own) and spoken >= len(own) // 2:
            return "repeat"
        return "children" if base in blocks.CONTAINERS and len(own) >= 2 else "atomic"

    def part(self, kids, n, base):
        mode = self.mode(kids, base)
        if mode == "atomic":
            return self.emit(kids)
        run = []
        for k in [*kids, None]:
            if k is not None and self.loose(k):
                run.append(k)
                continue
            if run:
                self.emit(run)
                run = []
            if k is None:
                continue
            if mode == "repeat" or self.atomic(k):
                self.emit([k])
            else:
                self.split(k, self.tag[k])


def random_html(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "div", "section", "article", "nav", "h2", "p", "ul", "li", "span", "table", "main", "h3"])
        inner = random_html(rng, depth + 1) if depth < 4 and rng.random() < 0.6 and tag not in ("h2", "h3", "p") else rng.choice(["words and more words", "short", ""])
        out += f"<{tag}>{inner}</{tag}>" + rng.choice(["", "", "tail text"])
    return out


def test_blocks_against_a_walk(spark):
    """Random pages: the same blocks as a recursive walk, every text in exactly one."""
    rng = random.Random(7)
    pages = [f"<body>{random_html(rng)}</body>" for _ in range(60)]
    t = tree(spark, *pages)
    rows = t.collect()
    got = {}
    for r in blocks.members(t, "page_id").where("tag = '#text'").collect():
        got.setdefault(r.page_id, {}).setdefault(r.block, []).append(r.node)
    for page in range(len(pages)):
        mine = [r for r in rows if r.page_id == page]
        body = next(r.node for r in mine if r.tag == "body")
        plain = Plain(mine)
        plain.split(body, "div")
        assert sorted(plain.out) == sorted(sorted(v) for v in got.get(page, {}).values())
        assert sorted(x for b in plain.out for x in b) == sorted(r.node for r in mine if r.tag == "#text")


def test_blocks_of_odd_pages(spark):
    """Null, empty, text alone, unclosed tags, scripts."""
    t = tree(spark, None, "", "only text", "<div><p>a<p>b<div>c", "<script>x = '<p>'</script><p>y", "<body><style>p {}</style></body>")
    got = {(r.page_id, r.text) for r in blocks.blocks(t, "page_id").collect()}
    assert got == {(2, "only text"), (3, "a b c"), (4, "y")}
    assert blocks.page_segments(t, "page_id").groupBy("page_id").count().count() == 6


LD = """<script type="application/ld+json">%s</script>"""


def found(spark, *parts):
    rows = structured.json_ld(tree(spark, *["".join(p) for p in parts]), "page_id").orderBy("page_id", "path").collect()
    return [(r.page_id, r.kind, r.name, r.value if r.kind == "field" else r.price) for r in rows]


def test_json_ld_of_any_depth(spark):
    deep = '{"@type":"WebPage","hasPart":' * 9 + '[{"@type":"Service","name":"deep","offers":[{"price":"1,200"}]}]' + "}" * 9
    assert found(spark, [LD % deep]) == [(0, "services", "deep", 1200.0), (0, "pricing", "Offer", 1200.0)]


def test_json_ld_lists_graphs_members_and_broken_scripts(spark):
    graph = '{"@graph":[{"@type":"Dentist","name":"no"},{"@type":"https://schema.org/MedicalOrganization","name":"Clinic","member":{"@type":"LocalBusiness","name":"Branch"}},7,null]}'
    listed = '[{"@type":"ItemList","name":"L","itemListElement":[{"@type":"Product","name":"P","offers":{"price":3}},{"name":"plain"},{"x":1}]},"s"]'
    got = found(spark, [LD % "{broken", LD % "", LD % graph, "<p>between</p>", LD % listed], ["<p>nothing</p>"], [LD % "3"])
    assert got == [
        (0, "field", "company_name", "Clinic"), (0, "field", "company_name", "Branch"), (0, "services", "plain", None), (0, "pricing", "P", 3.0),
    ]


def test_json_ld_products_offers_articles(spark):
    one = '{"@type":"Product","name":"A","category":"c"}'
    two = '{"@type":"Product","name":"B","offers":[{"@type":"AggregateOffer","lowPrice":"$1.50","highPrice":9},{"price":"2"}]}'
    three = '{"@type":["NewsArticle"],"headline":"H"}'
    four = '{"@type":"Event","subEvent":[{"@type":"Offer","name":"O","price":5}],"offers":{"price":6}}'
    got = found(spark, [LD % x for x in (one, two, three, four)])
    assert got == [(0, "pricing", "A", None), (0, "pricing", "B", 1.5), (0, "pricing", "B", 2.0), (0, "content", "H", None), (0, "pricing", "Offer", 6.0), (0, "pricing", "O", 5.0)]


def test_microdata_items_within_items(spark):
    html = """<div itemscope itemtype="https://schema.org/Organization"><span itemprop="name">Org</span>
    <div itemprop="makesOffer" itemscope itemtype="https://schema.org/Service"><b itemprop="name">Wash</b><i itemprop="name">second</i>
    <div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="$12.50"></div></div></div><p itemprop="name">stray</p>"""
    t = tree(spark, html)
    listed, props = structured.items(t, "page_id")
    types = {r.item: r.type for r in listed.collect()}
    assert sorted((r.type, types.get(r.owner), r.via) for r in listed.collect()) == [("Offer", "Service", "offers"), ("Organization", None, None), ("Service", "Organization", "makesOffer")]
    assert sorted((types[r.owner], r.name, r.value) for r in props.collect()) == [("Offer", "price", "$12.50"), ("Organization", "makesOffer", "Wash second"), ("Organization", "name", "Org"), ("Service", "name", "Wash"), ("Service", "name", "second")]
    got = {(r.kind, r.name, r.value, r.price) for r in structured.microdata(t, "page_id").collect()}
    assert ("services", "Wash", None, 12.5) in got and ("field", "company_name", "Org", None) in got


def test_merged_fills_only_what_is_open(spark):
    rows = [
        (1, 1, "json_ld", 0.3, [0], "field", "company_name", "A"), (1, 2, "semantic_html", 0.9, [0], "field", "company_name", "B"), (1, 6, "regex", 0.05, [3], "field", "contact_email", "late@x"),
        (1, 6, "regex", 0.05, [1], "field", "contact_email", "first@x"), (1, 3, "cards", 0.15, [1], "services", "S", None), (1, 1, "schema_org", 0.25, [9], "services", "S", None),
        (1, 5, "metadata", 0.1, [1], "field", "logo", None), (2, 5, "metadata", 0.1, [1], "field", "company_name", "T"), (1, 1, "x", 0.1, [0], "field", "social", "u1"), (1, 5, "y", 0.1, [0], "field", "social", "u2"),
    ]
    f = spark.createDataFrame(rows, "page_id int, pass int, strategy string, confidence double, path array<int>, kind string, name string, value string").selectExpr("*", "null description", "null category", "null price", "null high", "null currency")
    got = sorted((r.page_id, r.name, r.value or "", r.strategy) for r in structured.merged(f, "page_id").collect())
    assert got == [(1, "S", "", "schema_org"), (1, "company_name", "A", "json_ld"), (1, "contact_email", "first@x", "regex"), (1, "social", "u1", "x"), (1, "social", "u2", "y"), (2, "company_name", "T", "metadata")]


@pytest.mark.parametrize(
    ("url", "html", "kind", "confidence", "signals"),
    [
        ("https://a.com/", "<p>x</p>", "homepage", 0.9, ["url"]),
        ("https://a.com/pricing", "<title>Pricing</title><h1>Pricing</h1>", "pricing", 0.95, ["heading", "url"]),
        ("https://a.com/blog/1", '<meta property="og:type" content="article"><script type="application/ld+json">[{"@type":"BlogPosting"}]</script>', "blog", 0.8167, ["meta", "schema", "url"]),
        ("https://a.com/x", "<h2>Frequently <b>asked</b> questions</h2>", "faq", 0.95, ["heading"]),
        ("https://a.com/faq", "<h1>About us</h1>", "faq", 0.475, ["heading", "url"]),
        ("https://a.com/index.html", '<script type="application/ld+json">{broken</script>', "homepage", 0.8, ["url"]),
        ("https://a.com/x", "", "unknown", 0.1, []),
        (None, None, "unknown", 0.1, []),
    ],
)
def test_page_types(spark, url, html, kind, confidence, signals):
    from marketspark.operators import classification

    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    r = classification.page_types(pages, dom.tree(pages, "page_id"), "page_id").first()
    assert (r.type, round(r.confidence, 4), r.signals) == (kind, confidence, signals)


def test_pictures(spark):
    """A word more changes few bits, another text many; blank texts have blank pictures."""
    from pyspark.sql import functions as F

    from marketspark.operators import pictures

    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 999)) for _ in range(300))
    one, two = text(), text()
    rows = [("one", one), ("edit", "extra " + one), ("moved", " ".join(reversed(one.split()))), ("two", two), ("null", None), ("blank", " \n ")]
    h = {r.k: r.h for r in pictures.drawn(spark.createDataFrame(rows, "k string, t string"), ["k"], "t").select("k", pictures.difference_hash(F.col("grid")).alias("h")).collect()}
    d = lambda a, b: bin((h[a] ^ h[b]) & (1 << 64) - 1).count("1")
    assert d("one", "edit") <= pictures.SAME < 15 < d("one", "two") and d("one", "moved") == 0 and h["null"] == h["blank"] == 0
    assert spark.sql("select 1").select(pictures.distance(F.lit(h["one"]), F.lit(h["two"])).alias("x")).first().x == d("one", "two")
