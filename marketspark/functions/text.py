"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(x: str | Column) -> Column:
    """Lower case; runs of other characters than a-z and 0-9 become one space; trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", " "))


#: Words that carry no identity in names: articles and the like, and qualifiers.
STOP = (
    "the", "a", "an", "and", "or", "of", "in", "at", "to", "for", "with", "by", "on", "is", "are", "was", "were",
    "per", "its", "our", "your", "their", "this", "that", "these", "those",
)
REMOVABLE = (
    "service", "services", "plan", "plans", "package", "packages", "tier", "tiers", "option", "options", "solution", "solutions",
    "program", "programs", "system", "systems", "type", "types", "category", "categories", "feature", "features", "product", "products",
)
#: Short forms and what they stand for, in the order in which they are written out.
SHORT = {
    "hvac": "heating ventilation air conditioning",
    "ac": "air conditioning",
    "seo": "search engine optimization",
    "it": "information technology",
    "hr": "human resources",
    "diy": "do it yourself",
    "ui": "user interface",
    "ux": "user experience",
    "api": "application programming interface",
    "saas": "software as a service",
    "crm": "customer relationship management",
    "erp": "enterprise resource planning",
    "pos": "point of sale",
    "roi": "return on investment",
    "sla": "service level agreement",
    "qa": "quality assurance",
    "ai": "artificial intelligence",
    "ml": "machine learning",
    "devops": "development operations",
    "bi": "business intelligence",
}


def entity_key(x: str | Column) -> Column:
    """Lower case, punctuation as spaces, short forms written out one after the other, stop and qualifier words left out."""
    c = F.trim(F.regexp_replace(F.lower(_c(x)), r"[^\w]+|_", " "))
    for k, v in SHORT.items():
        c = F.regexp_replace(c, rf"\b{k}\b", v)
    return F.array_join(F.filter(F.split(c, "\\s+"), lambda w: ~w.isin(*STOP, *REMOVABLE) & (w != "")), " ")


def tokens(x: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize(x), " "), lambda w: w != ""))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of token sets; where one holds most of the other (0.8) and their sizes differ, 0.9 times that share if it is
    more. 0 if both are empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    least = F.least(F.size(a), F.size(b))
    jac, held = F.when(all_ > 0, both / all_).otherwise(0.0), F.when(least > 0, both / least).otherwise(0.0)
    return F.when((held >= 0.8) & (F.size(a) != F.size(b)), F.greatest(jac, 0.9 * held)).otherwise(jac)


def sorted_key(x: str | Column) -> Column:
    """Tokens in order, joined: a catalog key that word order doesn't change."""
    return F.array_join(F.array_sort(tokens(x)), " ")


def canonical(c: Column, kind: str) -> Column:
    """Text of a value for hashing: null is 'null', numbers plain, strings lower, trimmed, single-spaced."""
    if kind in ("double", "float"):
        c = F.format_string("%.6f", c)
    elif kind == "string":
        c = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.coalesce(c.cast("string"), F.lit("null"))


def content_hash(*columns: tuple[str, str]) -> Column:
    """SHA-256 over the canonical texts of (column, type), in order."""
    return F.sha2(F.concat_ws("|", *[canonical(F.col(n), k) for n, k in columns]), 256)
