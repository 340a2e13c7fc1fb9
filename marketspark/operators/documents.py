"""Captured pages: cleaning, links, metadata, entities, classification. Native expressions over the html text; tables, lists
and headings, which need nesting, go through one streaming parser in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a url or heading that tell the type of a page, in order of precedence.
PAGE_TYPES = (("pricing", "pric|plan|cost"), ("services", "service|product|shop"), ("about", "about|team"), ("contact", "contact|location"), ("blog", "blog|news|article|post"), ("faq", "faq|help"))
#: What a page's scripts and marks say about its technology.
TECHNOLOGY = {"jquery": "jquery", "react": "react", "vue": r"\bvue", "google_analytics": "gtag|google-analytics|track\\(", "bootstrap": "bootstrap", "wordpress": "wp-content"}


def clean(html: Column) -> Column:
    """Visible text: without scripts, styles, comments and tags; entities of the common five; white space single."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def declared_language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([a-z]{2})", 1)), F.lit(""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)href=\"([^\"]*)\""), 1)


def page_type(url: Column, heading: Column) -> Column:
    text, out = F.lower(F.concat_ws(" ", url, heading)), F
    for name, pattern in PAGE_TYPES:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("other")


def technologies(html: Column) -> Column:
    low = F.lower(html)
    return F.array_sort(F.filter(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in TECHNOLOGY.items()]), lambda x: x.isNotNull()))


def emails(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0), lambda x: F.lower(x))))


class _Blocks(HTMLParser):
    """(kind, text) of headings, paragraphs, list items and table cells, in order."""

    KINDS = {"h1": "heading", "h2": "heading", "h3": "heading", "p": "paragraph", "li": "item", "td": "cell", "th": "cell", "dt": "term", "dd": "definition", "summary": "question"}
    SKIP = {"script", "style", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.KINDS:
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif self.open and self.open[-1][0] == tag:
            kind, parts = self.open.pop()
            text = " ".join("".join(parts).split())
            if text:
                self.out.append((self.KINDS[kind], text))

    def handle_data(self, data):
        if self.open and not self.skip:
            self.open[-1][1].append(data)


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, position, kind, text: one row a block of each page's html."""

    def run(it):
        for pdf in it:
            rows = []
            for k, html in zip(pdf["page_id"], pdf["html"], strict=True):
                p = _Blocks()
                p.feed(html or "")
                p.close()
                rows += [(k, i, a, b) for i, (a, b) in enumerate(p.out)]
            yield pd.DataFrame(rows, columns=["page_id", "position", "kind", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, position int, kind string, text string")


def resolve(names: DataFrame, key: str, name: str, threshold: float = 0.55) -> DataFrame:
    """key, name, canonical: matching.resolve() of names within key, compared by their entity keys."""
    from marketspark.functions.text import entity_key
    from marketspark.operators import matching

    rows = names.select(key, F.col(name).alias("name"), F.split(entity_key(name), " ").alias("tokens"))
    rows = rows.withColumn("tokens", F.filter("tokens", lambda x: x != ""))
    return matching.resolve(rows, [key], threshold).withColumnRenamed("name", name)
